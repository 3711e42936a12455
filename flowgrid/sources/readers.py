"""Readers for the files of the field: cubes, zones, timetables, stations, facilities, observations.

All are lazy Spark scans with declared schemas; values that can't be cast become null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowgrid import contracts
from flowgrid.operators.flows import day_window, endpoint_prefix
from flowgrid.operators.transit import BOX, in_box

#: Columns of the raw cube, and the provinces of the study area.
RAW_COLUMNS = (
    "fecha", "periodo", "origen", "destino", "distancia", "actividad_origen", "actividad_destino", "estudio_origen_posible",
    "estudio_destino_posible", "residencia", "renta", "edad", "sexo", "viajes", "viajes_km",
)
RAW_SCHEMA = ", ".join(f"{c} {'double' if c.startswith('viajes') else 'string'}" for c in RAW_COLUMNS)
PROVINCES = ("08", "17", "25", "43")
KINDS = ("daily", "hourly")
#: The cube's own names for the raw columns.
NAMES = {
    "fecha": "day", "periodo": "hour", "origen": "origin", "destino": "dest", "distancia": "band", "actividad_origen": "act_o", "actividad_destino": "act_d",
    "renta": "income", "edad": "age", "sexo": "sex", "viajes": "trips", "viajes_km": "trip_km",
}


def as_cube(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed({k: v for k, v in NAMES.items() if k in raw.columns})


def raw_cube(spark: SparkSession, paths: str | Sequence[str], *, prefixes: Sequence[str] | None = PROVINCES, kind: str = "hourly", sep: str = "|") -> DataFrame:
    """Delimited text, gzipped or not, restricted to rows with an end under the prefixes (None: all)."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    raw = spark.read.schema(RAW_SCHEMA).option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(paths)
    raw = raw.withColumn("periodo", F.col("periodo").try_cast("int"))
    return raw.where(endpoint_prefix(prefixes, ("origen", "destino"))) if prefixes else raw


def checked_cube(spark: SparkSession, path: str, *, kind: str, prefixes: Sequence[str] | None = PROVINCES) -> DataFrame:
    """Semicolon-separated text with a header, held against its contract."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    kept = raw.where(endpoint_prefix(prefixes, ("origen", "destino"))) if prefixes else raw
    return (contracts.OD_HOURLY if kind == "hourly" else contracts.OD_DAILY).validate(kept)


def bronze(spark: SparkSession, root: str, *, zoning: str, kind: str, first: str | None = None, last: str | None = None, prefixes: Sequence[str] | None = None) -> DataFrame:
    """The partitioned store (zoning, kind, fecha), pruned to a window of days, both inclusive."""
    frame = spark.read.option("basePath", root).parquet(root)
    frame = frame.withColumn("fecha", F.col("fecha").cast("string")).where((F.col("zoning") == zoning) & (F.col("kind") == kind))
    frame = frame.withColumnRenamed("fecha", "day").where(day_window(first, last)).withColumnRenamed("day", "fecha")
    return frame.where(endpoint_prefix(prefixes, ("origen", "destino"))) if prefixes else frame


_POSITION = "array<double>"


def zones_geojson(spark: SparkSession, path: str, *, id_field: str = "ID") -> DataFrame:
    """(zone, properties, polygon): a row for each polygon of a FeatureCollection (multipolygons give several rows)."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.from_json(text, f"array<array<{_POSITION}>>")
    multi = F.from_json(text, f"array<array<array<{_POSITION}>>>")
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    polygons = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", F.array(single))
    shaped = raw.select(F.try_element_at("f.properties", F.lit(id_field)).alias("zone"), F.col("f.properties").alias("properties"), F.explode(polygons).alias("p"))
    return shaped.select("zone", "properties", F.transform("p", lambda ring: F.transform(ring, point)).alias("polygon"))


def stripped_csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings, with white space taken off the header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])


def gtfs_table(spark: SparkSession, path: str, name: str, columns: Sequence[str]) -> DataFrame:
    """A table of a timetable archive (.zip) or folder. Archives are read where they lie, row by row."""
    if not path.endswith(".zip"):
        table = stripped_csv(spark, f"{path}/{name}.txt")
        return table.select(*[F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns])

    def unzip(batches) -> Iterator:
        import csv
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(f"{name}.txt") as f:
                    rows = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"), skipinitialspace=True)
                    rows.fieldnames = [c.strip() for c in rows.fieldnames or []]
                    part = []
                    for row in rows:
                        part.append([row.get(c) or None for c in columns])
                        if len(part) >= 50_000:
                            yield pd.DataFrame(part, columns=list(columns))
                            part = []
                    yield pd.DataFrame(part, columns=list(columns), dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unzip, ", ".join(f"{c} string" for c in columns))


def gtfs_stops(spark: SparkSession, path: str, *, feed: str) -> DataFrame:
    raw = gtfs_table(spark, path, "stops", ("stop_id", "stop_name", "stop_lon", "stop_lat"))
    lon, lat = F.trim("stop_lon").try_cast("double"), F.trim("stop_lat").try_cast("double")
    placed = raw.select("stop_id", "stop_name", lon.alias("lon"), lat.alias("lat"), F.lit(feed).alias("feed"))
    return placed.dropna(subset=["stop_id", "lon", "lat"]).where(in_box(F.col("lon"), F.col("lat"), BOX))


def combined(*feeds: DataFrame) -> DataFrame:
    """All feeds as one bag of rows."""
    out, *rest = feeds
    for f in rest:
        out = out.unionByName(f)
    return out


#: The station file's columns.
STATION_NAMES = {
    "codi_estacio": "station_id", "nom_estacio": "station_name", "longitud": "lon", "latitud": "lat", "any": "year", "no2_anual": "no2_annual_ugm3",
    "pm25_anual": "pm25_annual_ugm3", "pm10_anual": "pm10_annual_ugm3", "o3_max8h": "o3_8h_max_ugm3",
}


def air_stations(spark: SparkSession, path: str) -> DataFrame:
    """Annual means by station; ids stay strings."""
    raw = stripped_csv(spark, path).withColumnsRenamed(STATION_NAMES).withColumn("operator", F.lit("XVPCA"))
    known = [c for c in contracts.STATIONS.fields if c in raw.columns]
    return contracts.STATIONS.validate(raw.select(*known))


def hourly_to_long(wide: DataFrame, ids: Sequence[str], prefix: str = "h") -> DataFrame:
    """Columns h01 to h24 as rows (hour 1 to 24, value)."""
    hours = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    long = wide.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in hours]).unpivot(list(ids), hours, "slot", "value")
    return long.select(*ids, F.substring("slot", len(prefix) + 1, 9).cast("int").alias("hour"), "value")


#: The region's box, and the names that columns go by (in lower case).
REGION = (0.15, 3.35, 40.50, 42.90)
FACILITY_NAMES = {
    "name": ("facilityname", "facility_name", "name"), "facility_id": ("facilityid", "facility_id"), "lon": ("long", "longitude", "lon"), "lat": ("lat", "latitude"),
    "total_emissions_t": ("totalquantity", "total_emissions_t"), "total_emissions_kg": ("pollutantreleaseandtransferquantitykg", "total_emissions_kg"),
}
HOSPITAL_NAMES = {
    "name": ("nom", "nombre", "denominacio", "name"), "code": ("codi", "codigo", "id"), "lon": ("longitud", "longitude", "lon", "lng"), "lat": ("latitud", "latitude", "lat"),
}


def by_alias(raw: DataFrame, names: dict[str, Sequence[str]], needed: Sequence[str] = ()) -> DataFrame:
    """A column for each name, from the first column with one of its aliases in any case; null if there is none and it isn't needed."""
    found = {k: next((c for c in raw.columns if c.lower() in aliases), None) for k, aliases in names.items()}
    if lacking := [k for k in needed if found[k] is None]:
        raise ValueError(f"no column for {lacking} among {raw.columns}")
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def facilities(spark: SparkSession, path: str, *, box: tuple[float, float, float, float] = REGION) -> DataFrame:
    """Industrial facilities under any of the usual column names; kilograms become tonnes."""
    raw = by_alias(stripped_csv(spark, path), FACILITY_NAMES, ("lon", "lat"))
    tonnes = F.coalesce(F.col("total_emissions_t").try_cast("double"), F.col("total_emissions_kg").try_cast("double") / 1000)
    out = raw.select("facility_id", "name", F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"), tonnes.alias("total_emissions_t"))
    return out.dropna(subset=["lon", "lat"]).where(in_box(F.col("lon"), F.col("lat"), box))


def hospitals(spark: SparkSession, path: str) -> DataFrame:
    """A registry of hospitals as points of interest; ids are hashes of the registry's codes."""
    raw = by_alias(stripped_csv(spark, path), HOSPITAL_NAMES, tuple(HOSPITAL_NAMES))
    tags = F.create_map(F.lit("source"), F.lit("registry"), F.lit("code"), F.col("code"))
    out = raw.select(
        F.pmod(F.xxhash64("code"), F.lit(1_000_000_000)).alias("osm_id"), F.lit("node").alias("osm_type"), F.lit("hospital").alias("category"), "name",
        F.col("lon").try_cast("double").alias("lon"), F.col("lat").try_cast("double").alias("lat"), tags.alias("tags"),
    )
    return out.dropna(subset=["lon", "lat"])


def protected_areas(frame: DataFrame, *, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """Areas (wdpa_id, name, designation, iucn_category, x0, y0, x1, y1) whose envelope meets the box."""
    return frame.where((F.col("x0") <= box[1]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[2]))


def scenes(catalogue: DataFrame, year: int, *, max_cloud: float = 20.0, platforms: Sequence[str] = ("landsat-8", "landsat-9"), min_sun: float = 30.0) -> DataFrame:
    """Summer scenes of a catalogue (acquired, cloud, platform, sun_elevation)."""
    summer = F.col("acquired").between(F.lit(f"{year}-06-01"), F.lit(f"{year}-08-31"))
    return catalogue.where(summer & (F.col("cloud") < max_cloud) & F.col("platform").isin(*platforms) & (F.col("sun_elevation") > min_sun))


def payload(spark: SparkSession, path: str, name: str = "PAYLOAD") -> DataFrame:
    """(json): the constant that a page's script assigns, from whole files."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.regexp_extract("value", rf"(?s)const\s+{name}\s*=\s*(\{{.*?\}});", 1).alias("json")).where("json <> ''")


def parse_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(o_lon, o_lat, d_lon, d_lat, value) of arcs in either of their shapes: nested ends, or flat columns."""
    schema = "source array<double>, target array<double>, value double, o_lon double, o_lat double, d_lon double, d_lat double, viajes double"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    at = lambda c, k, flat: F.coalesce(F.get(c, F.lit(k)), F.col(flat)).alias(flat)
    return raw.select(at("source", 0, "o_lon"), at("source", 1, "o_lat"), at("target", 0, "d_lon"), at("target", 1, "d_lat"), F.coalesce("value", "viajes").alias("value"))


# Paged sources


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PagedReader(DataSourceReader):
    """Pages of fixture files page-<offset>.json under a path, read in parallel until a page is empty or says it is the last."""

    def __init__(self, options):
        self.path, self.limit, self.pages = options["path"], int(options.get("limit", 300)), int(options.get("pages", 1))
        self.parts = max(1, int(options.get("partitions", 1)))

    def partitions(self):
        step = -(-self.pages // self.parts)
        return [Pages(k, min(k + step, self.pages)) for k in range(0, self.pages, step)]

    def read(self, partition):
        import json
        from pathlib import Path

        for page in range(partition.first, partition.last):
            file = Path(self.path) / f"page-{page * self.limit}.json"
            if not file.exists():
                return
            body = json.loads(file.read_text())
            for r in body.get("results", []):
                yield (str(r.get("key")), r.get("decimalLongitude"), r.get("decimalLatitude"), r.get("year"), r.get("kingdom"), r.get("occurrenceStatus"))
            if body.get("endOfRecords") or not body.get("results"):
                return


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_observations").options(path=..., limit=300, pages=n)"""

    @classmethod
    def name(cls):
        return "paged_observations"

    def schema(self):
        return "observation_id string, lon double, lat double, year int, taxon_kingdom string, status string"

    def reader(self, schema):
        return PagedReader(self.options)


def observations(frame: DataFrame, *, source: str = "gbif", box=BOX, most: int | None = None) -> DataFrame:
    """Observed (or unsaid) occurrences within the box, each once; at most so many, if a cap is the caller's wish."""
    present = F.col("status").isNull() | (F.col("status") == "PRESENT")
    kept = frame.where(present & in_box(F.col("lon"), F.col("lat"), box)).dropDuplicates(["observation_id"]).drop("status")
    kept = kept.withColumns({"source": F.lit(source), "research_grade": F.col("research_grade") if "research_grade" in frame.columns else F.lit(None).cast("boolean")})
    return kept.orderBy("observation_id").limit(most) if most else kept


# Planning downloads


@dataclass(frozen=True)
class RemoteFile:
    kind: str
    day: str
    url: str
    name: str


BASE_URL = "https://movilidad-opendata.mitma.es"


def plan_files(kind: str, days: Sequence[date], base: str = BASE_URL) -> list[RemoteFile]:
    """Where the day files of a kind lie; nothing is fetched."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    folder = "ficheros-diarios/" if kind == "daily" else ""
    out = []
    for d in days:
        name = f"{d:%Y%m%d}_Viajes_distritos.csv.gz"
        out.append(RemoteFile(kind, d.isoformat(), f"{base}/estudios_basicos/por-distritos/viajes/{folder}{d:%Y-%m}/{name}", name))
    return out


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists on its file system; raises if none does."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(f"none of {list(paths)}")


def stored_days(frame: DataFrame) -> DataFrame:
    """(first, last, days) of a partitioned store."""
    return frame.select("fecha").distinct().agg(F.min("fecha").alias("first"), F.max("fecha").alias("last"), F.count("*").alias("days"))
