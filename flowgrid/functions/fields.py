"""What each field of a cell table means to a reader (fixed values): kind, good end, pivot, and its short seasonal name."""

from __future__ import annotations

from typing import NamedTuple


class Meaning(NamedTuple):
    kind: str = "sequential"
    good: str = "neutral"
    pivot: float | None = None
    season: str | None = None


FIELDS = {
    "score": Meaning("score", "high"),
    "mitma_inflow_daily": Meaning(), "mitma_outflow_daily": Meaning(), "mitma_through_ratio": Meaning("diverging", pivot=1.0),
    "am_peak_share": Meaning(season="am"), "pm_peak_share": Meaning(season="pm"), "midday_share": Meaning(season="mid"), "night_share": Meaning(season="night"),
    "peak_hour_bucket": Meaning("categorical", season="peak"),
    "weekend_weekday_ratio": Meaning("diverging", pivot=1.0, season="wwr"), "weekend_hotspot_score": Meaning("diverging", pivot=1.0, season="whs"),
    "weekend_hotspot_summer_minus_winter": Meaning("diverging", pivot=0.0), "weekend_ratio_summer_minus_winter": Meaning("diverging", pivot=0.0),
    "leisure_share": Meaning(season="leis"), "commute_share": Meaning(season="comm"), "mobility_typology": Meaning("categorical"),
    "intra_zone_share": Meaning(good="high"), "geodemo_diversity": Meaning(good="high"), "low_income_inflow_share": Meaning(),
    "youth_mobility_share": Meaning(), "senior_mobility_share": Meaning(), "female_share": Meaning(), "support_n": Meaning(),
    "train_reach_min": Meaning("presence", "low"), "trains_per_day_nearest": Meaning(good="high"), "trains_to_bcn_nearest": Meaning(good="high"),
    "climb_min_m": Meaning("presence", "low"), "yoga_min_m": Meaning("presence", "low"), "hospital_min_m": Meaning("presence", "low"),
    "green_min_m": Meaning("presence", "low"), "sea_min_m": Meaning("presence", "low"), "pharmacy_density_per_km2": Meaning(good="high"),
    "tree_cover_pct": Meaning(good="high"), "natura2000_within_5km": Meaning("boolean", "high"), "biodiversity_obs_density": Meaning(good="high"),
    "no2_ugm3": Meaning(good="low"), "pm25_ugm3": Meaning(good="low"), "uhi_delta_c": Meaning("diverging", "low", 0.0), "viirs_radiance": Meaning(),
    "eprtr_facility_min_m": Meaning("presence", "high"), "industry_density_per_km2": Meaning(), "motorway_within_500m": Meaning("boolean"),
}
