"""Writers: partitioned stores, JSON records, slices, manifests, and a standalone page."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.functions.display import safe_json
from flowgrid.operators import stats

#: Most rows that a standalone page takes of each layer: a limit of what a browser draws.
PAGE_CAPS = {"cells": 60_000, "arcs": 5_000, "places": 5_000}


def write_bronze(raw: DataFrame, root: str, *, zoning: str, kind: str) -> None:
    """The raw cube by zoning, kind and day; only the partitions written are replaced.

    Rows are gathered by day in tasks of about the advisory partition size: a large day is split, small ones share a task.
    """
    marked = raw.withColumns({"zoning": F.lit(zoning), "kind": F.lit(kind)})
    parts = marked.hint("rebalance", F.col("fecha")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    parts.partitionBy("zoning", "kind", "fecha").parquet(root)


def ingest(spark, paths: str | Sequence[str], root: str, *, zoning: str, kind: str, **options) -> None:
    from flowgrid.sources.readers import raw_cube

    write_bronze(raw_cube(spark, paths, kind=kind, **options), root, zoning=zoning, kind=kind)


def write_kind(frame: DataFrame, folder: str, *, kind: str, by: str = "fecha") -> str:
    """A store below a folder of its kind."""
    path = f"{folder}/{kind}"
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def write_table(frame: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_records(frame: DataFrame, path: str, rounding: Mapping[str, int] | None = None) -> None:
    """JSON lines without NaN or infinities, nulls written out."""
    frame.select(safe_json(frame, rounding).alias("value")).write.mode("overwrite").text(path)


def rounded(frame: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """Columns rounded; 0 places make a nullable integer."""
    one = lambda c: F.round(c, places[c]).cast("bigint") if places[c] == 0 else F.round(c, places[c])
    return frame.select(*[one(c).alias(c) if c in places else F.col(f"`{c}`") for c in frame.columns])


def season_objects(frame: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """(cell, json): {season: {short name: value}} of a long table with a season; three seasons at most."""
    value = F.struct(*[F.col(c).alias(short) for c, short in measures.items()])
    by_cell = frame.groupBy("cell").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("season", value.alias("v"))))).alias("m"))
    return by_cell.select("cell", F.to_json("m", {"ignoreNullFields": "false"}).alias("json"))


def write_slices(sliced: DataFrame, path: str) -> None:
    """Slices as JSON lines, a folder for each season and day type."""
    sliced.repartition("season", "day_type").sortWithinPartitions("season", "day_type", F.desc("trips_day"), "origin", "dest").write.mode("overwrite").partitionBy("season", "day_type").json(path)


def manifest(frame: DataFrame, features: Sequence[str], score: str = "liveability_score") -> str:
    """A table's row count, coverage and score statistics as one JSON object."""
    cover = {r.feature: r.coverage for r in stats.coverage(frame, features).collect()}
    summary = stats.describe(frame, [score]).first().asDict() if score in frame.columns else {}
    return json.dumps({"rows": frame.count(), "coverage": cover, "score": summary}, allow_nan=False, sort_keys=True)


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title></head>
<body><div id="map"></div><script>
const PAYLOAD = {payload};
</script></body></html>
"""


def write_page(path: str, title: str, cells: DataFrame, arcs: DataFrame | None = None, places: DataFrame | None = None) -> None:
    """A page that carries its data, up to the caps above."""
    take = lambda df, cap: [json.loads(r.j) for r in df.limit(cap).select(safe_json(df).alias("j")).collect()] if df is not None else []
    data = {"cells": take(cells, PAGE_CAPS["cells"]), "arcs": take(arcs, PAGE_CAPS["arcs"]), "places": take(places, PAGE_CAPS["places"])}
    text = json.dumps(data, allow_nan=False).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=title.replace("<", "&lt;"), payload=text))


def arrow_arcs(arcs: DataFrame):
    """Arcs as an Arrow table, for a plotting library."""
    return arcs.toArrow()
