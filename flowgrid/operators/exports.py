"""What is handed on: slices with their locations and index, story tables, typologies of zones, unions of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgrid.functions import geo
from flowgrid.operators import flows, score, spatial, stats

DAY_TYPES = ("weekday", "weekend")


# Slices


def located(pairs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Pairs with both ends among the zones that have a place."""
    ends = centroids.select("zone").distinct()
    for end in ("origin", "dest"):
        pairs = pairs.join(ends, pairs[end] == ends["zone"], "left_semi")
    return pairs


def slice_of(sliced: DataFrame, season: str, day_type: str) -> DataFrame:
    """One slice by its key; a key that names no slice is an error."""
    if season not in flows.SEASONS.values() or day_type not in DAY_TYPES:
        raise KeyError(f"no slice {season}/{day_type}: seasons are {sorted(flows.SEASONS.values())}, day types {DAY_TYPES}")
    return sliced.where((F.col("season") == season) & (F.col("day_type") == day_type))


def flow_ranks(sliced: DataFrame) -> DataFrame:
    """Corridors of each slice with their dense rank: equal flows share a rank, and none is skipped."""
    by_flow = W.partitionBy("season", "day_type").orderBy(F.desc("trips_day"))
    return sliced.withColumn("flow_rank", F.dense_rank().over(by_flow))


def slice_index(sliced: DataFrame) -> DataFrame:
    """(season, day_type, flows, locations, lo, hi, all_lo, all_hi): each slice's size and domain, and the domain of all slices."""
    ends = sliced.select("season", "day_type", "trips_day", F.explode(F.array("origin", "dest")).alias("zone"))
    each = ends.groupBy("season", "day_type").agg(
        (F.count("*") / 2).cast("long").alias("flows"), F.countDistinct("zone").alias("locations"), F.min("trips_day").alias("lo"), F.max("trips_day").alias("hi")
    )
    whole = W.partitionBy()  # over the slices: as many as seasons and day types
    return each.withColumns({"all_lo": F.min("lo").over(whole), "all_hi": F.max("hi").over(whole)})


def dominant_places(xwalk: DataFrame, places: DataFrame) -> DataFrame:
    """(zone, lon, lat): each zone at its dominant cell; places has cell, lon and lat."""
    return flows.dominant_cells(xwalk).join(places, "cell").select("zone", "lon", "lat")


# Zones


def zone_indices(od: DataFrame) -> DataFrame:
    """The typology's shares of each zone itself."""
    parts = flows.typology_parts(od)
    ratios = {k: flows.guarded(F.col(n), F.col(d)) for k, (n, d) in flows.TYPOLOGY.items()}
    return parts.select("zone", *[v.alias(k) for k, v in ratios.items()], flows.log_balance(F.col("tot_out"), F.col("tot_in")).alias("sink_source"))


def zone_typology(od: DataFrame, xwalk: DataFrame, **options) -> DataFrame:
    """(cell, label): zones clustered by their own indices; cells take the label of their zone of greatest weight."""
    labels = flows.typology(zone_indices(od), key="zone", **options)
    return flows.spread_label(labels.select("zone", "label"), xwalk, "label")


def zone_profile(od: DataFrame) -> DataFrame:
    """(zone, h0 to h23): each zone's arrivals by hour as shares of its day."""
    hours = [f"h{h}" for h in range(24)]
    sums = od.groupBy(F.col("dest").alias("zone")).agg(F.sum("trips").alias("day"), *[flows.sum_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)])
    return sums.select("zone", *[flows.guarded(F.col(h), F.col("day")).alias(h) for h in hours])


def cluster_centers(frame: DataFrame, by: str, features: Sequence[str] = tuple(flows.TYPOLOGY)) -> DataFrame:
    """Each cluster's size and centre in the features' own units (nulls are left out)."""
    return frame.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features])


def on_grid(frame: DataFrame, grid: DataFrame, key: str = "cell") -> DataFrame:
    """Rows whose cell belongs to a grid."""
    return frame.join(grid.select(key).distinct(), key, "left_semi")


# Places


def one_place_each(*sources: DataFrame) -> DataFrame:
    """(lon, lat) of all sources' places, each point once."""
    out = sources[0].select("lon", "lat")
    for s in sources[1:]:
        out = out.unionByName(s.select("lon", "lat"))
    return out.dropna().distinct()


def one_row_each(frame: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the least in that order. Rows without a key stay."""
    first = F.min(F.struct(*order, *[c for c in frame.columns if c not in (*order, key)])).alias("row")
    kept = frame.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "row.*").select(*frame.columns)
    return kept.unionByName(frame.where(F.col(key).isNull()))


def on_land(areas: DataFrame, land: DataFrame) -> DataFrame:
    """Areas (zone, polygon) of which some part lies on land; land has cell and ring, convex pieces without overlap."""
    share = spatial.overlay_weights(areas, land).groupBy("zone").agg(F.sum("weight").alias("w")).where("w > 0")
    return areas.join(share.select("zone"), "zone", "left_semi")


def near_protected(points: DataFrame, areas: DataFrame, land: DataFrame, within: float = 5000.0) -> DataFrame:
    """points with a flag: whether an area with land in it is so near."""
    near = spatial.nearest_shape(points, on_land(areas, land), within, "near_m")
    return near.withColumn("natura2000_within_5km", F.col("near_m").isNotNull()).drop("near_m")


# Story


def story_cells(frame: DataFrame, key: str = "cell", places: int = 1) -> DataFrame:
    """Each cell's score under every preset, rounded as SQL does: the product with the power of ten is, not the decimal digits."""
    rounded = lambda s: F.round(s * 10.0**places) / 10.0**places
    return frame.select(key, *[rounded(score.score(frame, score.load_weights(p))).alias(f"score_{p}") for p in score.PRESETS])


def story_statistics(frame: DataFrame, places: int = 2) -> DataFrame:
    """Distribution of every preset's score."""
    scored = frame.select(*[score.score(frame, score.load_weights(p)).alias(p) for p in score.PRESETS])
    out = stats.describe(scored, list(score.PRESETS))
    return out.select(F.col("feature").alias("preset"), *[F.round(c, places).alias(c) for c in stats.STATISTICS])


def cell_places(xwalk: DataFrame, lon, lat) -> DataFrame:
    """(cell, lon, lat) of a crosswalk's cells, by column expressions."""
    return xwalk.select("cell").distinct().select("cell", lon.alias("lon"), lat.alias("lat"))


def lattice_places(cells: DataFrame, zone: int = 31) -> DataFrame:
    """(cell, lon, lat) of lattice cells, by their ids."""
    q, r = geo.axes_of(F.col("cell"))
    lon, lat = geo.lonlat(*geo.cell_center(q, r), zone)
    return cells.select("cell", lon.alias("lon"), lat.alias("lat"))
