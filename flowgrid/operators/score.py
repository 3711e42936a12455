"""Multi-criteria scores of cells: one column expression, no functions of our own in the plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Default weights, and what each preset changes.
WEIGHTS = {
    "base_offset": 50.0,
    "train_reach_per_min_under25": 1.4, "trains_to_bcn_per_30": 1.0, "climb_reward": 5.0, "yoga_reward": 4.0, "green_reward": 6.0,
    "sea_within_3km_bonus": 6.0, "tree_cover_pct": 0.15, "natura2000_within_5km": 5.0, "biodiversity_obs_log": 1.0,
    "no2_above_who_per_ugm3": -0.5, "pm25_above_who_per_ugm3": -1.2, "uhi_per_degree": -2.0, "viirs_radiance": -0.05,
    "industry_density": -6.0, "eprtr_inverse_dist": -0.001, "motorway_within_500m": -12.0, "hospital_reward": 5.0, "pharmacy_density_log": 1.0,
    "mitma_through_ratio": 0.0, "geodemo_diversity": 0.0, "intra_zone_share": 0.0, "weekend_hotspot_score": 0.0, "leisure_share": 0.0, "night_share": 0.0,
}
PRESETS = {
    "default": {},
    "nature_first": {"climb_reward": 2.5, "yoga_reward": 2.0, "green_reward": 12.0, "sea_within_3km_bonus": 12.0, "tree_cover_pct": 0.30, "natura2000_within_5km": 10.0, "biodiversity_obs_log": 2.0},
    "quiet_strict": {"no2_above_who_per_ugm3": -1.5, "pm25_above_who_per_ugm3": -3.6, "uhi_per_degree": -6.0, "motorway_within_500m": -36.0, "industry_density": -18.0, "mitma_through_ratio": -0.5, "viirs_radiance": -0.15},
    "amenity_first": {"climb_reward": 10.0, "yoga_reward": 8.0, "hospital_reward": 10.0, "pharmacy_density_log": 2.0, "natura2000_within_5km": 2.5, "biodiversity_obs_log": 0.5},
}
CATCHMENT_M = 10_000.0
#: Features the terms read; columns that a table lacks count as null.
FEATURES = {
    "train_reach_min": "double", "trains_to_bcn_nearest": "double", "climb_min_m": "double", "yoga_min_m": "double", "green_min_m": "double",
    "sea_min_m": "double", "tree_cover_pct": "double", "natura2000_within_5km": "boolean", "biodiversity_obs_density": "double",
    "no2_ugm3": "double", "pm25_ugm3": "double", "uhi_delta_c": "double", "viirs_radiance": "double", "industry_density_per_km2": "double",
    "eprtr_facility_min_m": "double", "motorway_within_500m": "boolean", "hospital_min_m": "double", "pharmacy_density_per_km2": "double",
    "mitma_through_ratio": "double", "geodemo_diversity": "double", "intra_zone_share": "double", "weekend_hotspot_score": "double", "leisure_share": "double", "night_share": "double",
}


def load_weights(preset: str = "default", path: str | None = None) -> dict[str, float]:
    """A preset's weights: the default's, with the preset's changes. A YAML file may replace the built-in ones."""
    if path:
        import yaml

        with open(path) as f:
            table = yaml.safe_load(f)
        base, changes = table["default"], table
    else:
        base, changes = WEIGHTS, PRESETS
    if preset not in changes:
        raise KeyError(f"no preset {preset!r}; there are {sorted(changes)}")
    return dict(base) | (dict(changes[preset]) if preset != "default" else {})


def closeness(distance: Column, weight: float) -> Column:
    """Full weight at 0 m, none from the catchment's edge on; 0 for null."""
    return F.coalesce(weight * F.greatest(F.lit(0.0), 1 - distance / CATCHMENT_M), F.lit(0.0))


def _terms(col, w: Mapping[str, float]) -> dict[str, Column]:
    """Terms by weight, in the order of their sum; null is neutral, and a flag counts only if it is true."""
    over = lambda c, floor: F.greatest(F.lit(0.0), col(c) - floor)
    flag = lambda c: F.when(col(c), 1.0)
    per_weight = {
        "train_reach_per_min_under25": F.greatest(F.lit(0.0), 25 - col("train_reach_min")),
        "trains_to_bcn_per_30": col("trains_to_bcn_nearest") / 30,
        **{f"{k}_reward": closeness(col(f"{k}_min_m"), 1.0) for k in ("climb", "yoga", "green", "hospital")},
        "sea_within_3km_bonus": F.when(col("sea_min_m") < 3000, 1.0),
        "tree_cover_pct": col("tree_cover_pct"),
        "natura2000_within_5km": flag("natura2000_within_5km"),
        "biodiversity_obs_log": F.ln(1 + col("biodiversity_obs_density")),
        "no2_above_who_per_ugm3": over("no2_ugm3", 20),
        "pm25_above_who_per_ugm3": over("pm25_ugm3", 5),
        "uhi_per_degree": over("uhi_delta_c", 0),
        "viirs_radiance": col("viirs_radiance"),
        "industry_density": col("industry_density_per_km2"),
        "eprtr_inverse_dist": 1 / F.when(col("eprtr_facility_min_m") > 0, col("eprtr_facility_min_m")),
        "motorway_within_500m": flag("motorway_within_500m"),
        "pharmacy_density_log": F.ln(1 + col("pharmacy_density_per_km2")),
        **{k: col(k) for k in ("mitma_through_ratio", "geodemo_diversity", "intra_zone_share", "weekend_hotspot_score", "leisure_share", "night_share")},
    }
    # greatest() skips nulls, so the terms with a floor need the feature itself to be there.
    needs = {"train_reach_per_min_under25": "train_reach_min", "no2_above_who_per_ugm3": "no2_ugm3", "pm25_above_who_per_ugm3": "pm25_ugm3", "uhi_per_degree": "uhi_delta_c"}
    return {k: F.coalesce(F.when(col(needs[k]).isNotNull(), x) if k in needs else x, F.lit(0.0)) * float(w.get(k, 0)) for k, x in per_weight.items()}


def score(frame: DataFrame, weights: Mapping[str, float]) -> Column:
    """The sum of all terms with a weight, within 0 and 100. Its order is fixed: another one ends in other last bits."""
    col = lambda c: F.col(c) if c in frame.columns else F.lit(None).cast(FEATURES[c])
    total = F.lit(float(weights.get("base_offset", 50.0)))
    for key, term in _terms(col, weights).items():
        if weights.get(key):
            total = total + term
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def with_score(frame: DataFrame, preset: str = "default", weights: Mapping[str, float] | None = None, name: str = "liveability_score") -> DataFrame:
    return frame.withColumn(name, score(frame, weights if weights is not None else load_weights(preset)))


def sensitivity(frame: DataFrame, key: str = "cell", presets: Sequence[str] = tuple(PRESETS), k: int = 10) -> DataFrame:
    """Jaccard overlaps of the presets' k best cells (ties: by key), a row for each pair of presets."""
    scored = frame.select(key, *[score(frame, load_weights(p)).alias(p) for p in presets])
    long = scored.unpivot([key], list(presets), "preset", "s")
    best = F.row_number().over(W.partitionBy("preset").orderBy(F.desc("s"), key))
    tops = long.withColumn("r", best).where(F.col("r") <= k).groupBy("preset").agg(F.collect_set(key).alias("ids"))  # k ids each
    a, b = tops.select(F.col("preset").alias("a"), F.col("ids").alias("x")), tops.select(F.col("preset").alias("b"), F.col("ids").alias("y"))
    union = F.size(F.array_union("x", "y"))
    overlap = F.when(union > 0, F.size(F.array_intersect("x", "y")) / union).otherwise(0.0)
    return a.join(F.broadcast(b)).select("a", "b", F.round(overlap, 3).alias("jaccard"))  # as many rows as presets


#: Fixed values of the first generation: a distance costs a point for each so many metres, up to a cap.
LEGACY = {"climb_min_m": (200.0, 5000.0), "yoga_min_m": (250.0, 5000.0), "green_min_m": (200.0, 4000.0), "hospital_min_m": (400.0, 8000.0)}
LEGACY_TERMS = (
    "train_reach_per_min_under25", "trains_to_bcn_per_30", "sea_within_3km_bonus", "industry_density", "motorway_within_500m", "pharmacy_density_log", "mitma_through_ratio",
)
#: What the form with a catchment adds; its cap holds for all distances but that to green.
CATCHMENT_TERMS = (
    "tree_cover_pct", "natura2000_within_5km", "biodiversity_obs_log", "no2_above_who_per_ugm3", "pm25_above_who_per_ugm3", "uhi_per_degree", "viirs_radiance", "eprtr_inverse_dist",
)


def legacy_score(frame: DataFrame, weights: Mapping[str, float] = WEIGHTS, catchment: float | None = None) -> Column:
    """The first generation of scores, kept for comparison: distances cost points, up to a cap; null is neutral."""
    col = lambda c: F.col(c) if c in frame.columns else F.lit(None).cast(FEATURES[c])
    total, terms = F.lit(float(weights.get("base_offset", 50.0))), _terms(col, weights)
    for key in LEGACY_TERMS + (CATCHMENT_TERMS if catchment else ()):
        if weights.get(key):
            total = total + terms[key]
    for c, (per, cap) in LEGACY.items():
        cap = catchment if catchment and c != "green_min_m" else cap
        total = total - F.coalesce(F.when(col(c).isNotNull(), F.least(col(c), F.lit(cap)) / per), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def report(frame: DataFrame, column: str = "liveability_score") -> DataFrame:
    """Distribution of a score with its counts at the floor and the cap."""
    c = F.col(column)
    return frame.agg(
        F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
        F.percentile(c, F.lit(0.5)).alias("median"), F.count_if(c <= 0).alias("at_floor"), F.count_if(c >= 100).alias("at_cap"),
    )
