"""Points of interest: ordered tag rules, stations, green areas and coastlines from tagged elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in order, each with the key=value tags that match it.
RULES = {
    "climbing": (("sport", "climbing"), ("leisure", "climbing")),
    "yoga": (("sport", "yoga"),),
    "park": (("leisure", "park"), ("leisure", "garden"), ("leisure", "nature_reserve")),
    "hospital": (("amenity", "hospital"),),
    "clinic": (("amenity", "clinic"),),
    "doctors": (("amenity", "doctors"),),
    "pharmacy": (("amenity", "pharmacy"),),
    "industry": (("landuse", "industrial"),),
}
#: Tags of green areas, and of stations.
GREEN = {"leisure": ("park", "garden", "nature_reserve"), "landuse": ("forest", "meadow", "recreation_ground"), "natural": ("wood", "grassland", "heath")}
STATIONS = ("station", "halt")
#: What a station without a timetable counts as.
STATION_TRIPS, STATION_FEED = 12, "osm"


def category(tags: Column, only: Sequence[str] | None = None) -> Column:
    """The first category with a matching tag; null if there is none, or no tags."""
    out = F.when(F.lit(False), "")
    for name, tests in RULES.items():
        if only is None or name in only:
            hit = F.lit(False)
            for k, v in tests:
                hit = hit | F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False))
            out = out.when(hit, name)
    return out


def categorise(pois: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """pois (with tags) with their category; those without one go."""
    return pois.withColumn("category", category(F.col("tags"), only)).where(F.col("category").isNotNull())


def tagged(elements: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Elements with any of the values of any of the keys."""
    test = F.lit(False)
    for key, values in wanted.items():
        test = test | F.coalesce(F.try_element_at("tags", F.lit(key)).isin(*values), F.lit(False))
    return elements.where(test)


def stations(elements: DataFrame) -> DataFrame:
    """Stations that stand in for stops where there is no timetable."""
    at = tagged(elements, {"railway": STATIONS}).where("location is not null and kind = 'node'")
    key = F.col("id").cast("string")
    name = F.coalesce(F.try_element_at("tags", F.lit("name")), F.concat(F.lit("station_"), key))
    return at.select(
        key.alias("stop_id"), name.alias("stop_name"), F.col("location.longitude").alias("lon"), F.col("location.latitude").alias("lat"),
        F.lit(STATION_TRIPS).alias("trips_per_day"), F.lit(STATION_FEED).alias("feed"),
    )


def green_areas(elements: DataFrame) -> DataFrame:
    return tagged(elements, GREEN)


def coastlines(elements: DataFrame) -> DataFrame:
    return tagged(elements, {"natural": ("coastline",)})


def network(elements: DataFrame, kinds: Sequence[str] = ("highway", "railway")) -> DataFrame:
    """(osm_id, kind, subtype, line): ways put together from their nodes, in order.

    elements: id, kind (node or way), location, refs, tags.  Lines are as long as their way's list of nodes.
    """
    kind = F.when(F.lit(False), "")
    for k in kinds:
        kind = kind.when(F.try_element_at("tags", F.lit(k)).isNotNull(), k)
    ways = elements.where("kind = 'way'").withColumn("class", kind).where(F.col("class").isNotNull())
    refs = ways.select(F.col("id").alias("osm_id"), F.col("class").alias("kind"), F.try_element_at("tags", F.col("class")).alias("subtype"), F.posexplode("refs").alias("at", "node"))
    nodes = elements.where("kind = 'node' and location is not null").select(F.col("id").alias("n"), F.col("location.longitude").alias("x"), F.col("location.latitude").alias("y"))
    placed = refs.join(nodes, F.col("node") == F.col("n"))
    lines = placed.groupBy("osm_id", "kind", "subtype").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    return lines.select("osm_id", "kind", "subtype", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
