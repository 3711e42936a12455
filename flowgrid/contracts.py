"""Data contracts: declared columns with types and rules, checked in one pass over the data.

A contract casts what it knows, drops columns it doesn't know if it is strict, counts the rows that
break each rule in a single aggregate, and finds repeated keys by a partial count.  All failures are
reported together.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column: its Spark type, and the values it may have."""

    type: str
    nullable: bool = False
    required: bool = True
    unique: bool = False
    isin: tuple = ()
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    length: tuple[int, int] | None = None

    def broken(self, raw: Column, cast: Column) -> dict[str, Column]:
        """Rules by name, each with the condition that breaks it."""
        out = {"type": raw.isNotNull() & cast.isNull()}
        if not self.nullable:
            out["null"] = raw.isNull()
        if self.isin:
            out["domain"] = ~cast.isin(*self.isin)
        if self.least is not None or self.most is not None:
            low = cast < self.least if self.least is not None else F.lit(False)
            out["range"] = low | (cast > self.most if self.most is not None else F.lit(False))
        if self.pattern:
            out["pattern"] = ~cast.rlike(self.pattern)
        if self.length:
            out["length"] = ~F.length(cast).between(*self.length)
        return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


class ContractError(ValueError):
    """All failures of a frame: (column, rule, rows)."""

    def __init__(self, name: str, failures: list[tuple[str, str, int]]):
        self.failures = failures
        super().__init__(f"{name}: " + "; ".join(f"{c} breaks {r} in {n} rows" for c, r, n in failures))


@dataclass(frozen=True)
class Contract:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    strict: bool = False

    def extend(self, name: str, **fields: Field) -> Contract:
        return replace(self, name=name, fields=self.fields | fields)

    def conform(self, frame: DataFrame) -> DataFrame:
        """Known columns cast (what can't be is null); others are kept only if the contract isn't strict."""
        cast = [F.col(f"`{c}`").try_cast(f.type).alias(c) for c, f in self.fields.items() if c in frame.columns]
        other = [] if self.strict else [F.col(f"`{c}`") for c in frame.columns if c not in self.fields]
        return frame.select(*cast, *other)

    def report(self, frame: DataFrame) -> DataFrame:
        """(column, rule, rows) for every rule, with the number of rows that break it."""
        counts = []
        for c, f in self.fields.items():
            if c in frame.columns:
                raw = F.col(f"`{c}`")
                cast = raw if f.type.startswith(("map", "binary", "array", "struct")) else raw.try_cast(f.type)
                counts += [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.count_if(x).alias("rows")) for r, x in f.broken(raw, cast).items()]
            elif f.required:
                counts.append(F.struct(F.lit(c).alias("column"), F.lit("missing").alias("rule"), F.count("*").alias("rows")))
        out = frame.agg(F.array(*counts).alias("r")).select(F.inline("r"))
        for c in (c for c, f in self.fields.items() if f.unique and c in frame.columns):
            repeated = frame.groupBy(F.col(f"`{c}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
            out = out.unionByName(repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(c).alias("column"), F.lit("unique").alias("rule"), "rows"))
        return out

    def validate(self, frame: DataFrame) -> DataFrame:
        """The conformed frame; raises ContractError with all failures."""
        missing = [(c, "missing", -1) for c, f in self.fields.items() if f.required and c not in frame.columns]
        failures = missing + [(r.column, r.rule, r.rows) for r in self.report(frame).where("rows > 0").collect() if r.rule != "missing"]
        if failures:
            raise ContractError(self.name, failures)
        return self.conform(frame)


# The domains, and the columns of each source.
BANDS = ("0.5-2", "2-10", "10-50", "50-100", ">100")
ACTIVITIES = ("casa", "trabajo_estudio", "frecuente", "no_frecuente")
INCOMES = ("<10", "10-15", ">15", "NA")
AGES = ("0-25", "25-45", "45-65", "65-100", "NA")
SEXES = ("hombre", "mujer", "NA")


def text(**rules) -> Field:
    return Field("string", **rules)


def real(least: float | None = None, most: float | None = None, **rules) -> Field:
    return Field("double", least=least, most=most, **rules)


def whole(least: float | None = None, most: float | None = None, **rules) -> Field:
    return Field("bigint", least=least, most=most, **rules)


LON, LAT = real(0.0, 4.0), real(40.5, 42.9)
ZONE = text(length=(4, 24))
OD_DAILY = Contract(
    "od_daily",
    {
        "fecha": text(pattern=r"^\d{8}$"), "origen": ZONE, "destino": ZONE, "distancia": text(isin=BANDS),
        "actividad_origen": text(isin=ACTIVITIES), "actividad_destino": text(isin=ACTIVITIES), "viajes": real(0), "viajes_km": real(0),
        "residencia": text(nullable=True, required=False), "renta": text(nullable=True, required=False, isin=INCOMES),
        "edad": text(nullable=True, required=False, isin=AGES), "sexo": text(nullable=True, required=False, isin=SEXES),
    },
    strict=True,
)
OD_HOURLY = OD_DAILY.extend("od_hourly", periodo=whole(0, 23))
ZONES = Contract("zones", {"id": text(length=(4, 24), unique=True), "name": text(nullable=True), "municipio_id": text(nullable=True), "provincia": text(pattern=r"^\d{2}$"), "geometry": text()})
POI = Contract("poi", {"osm_id": whole(unique=True), "osm_type": text(isin=("node", "way", "relation")), "category": text(), "name": text(nullable=True), "lon": LON, "lat": LAT, "tags": Field("map<string,string>", nullable=True)})
NETWORK = Contract("network", {"osm_id": whole(), "kind": text(isin=("highway", "railway", "coastline")), "subtype": text(nullable=True), "geometry": text()})
STOPS = Contract("stops", {"stop_id": text(unique=True), "stop_name": text(), "lon": LON, "lat": LAT, "feed": text(isin=("rodalies", "fgc"))})
FREQUENCY = Contract("frequency", {"stop_id": text(unique=True), "trips_per_day": whole(0), "trips_to_bcn_core": whole(0)})
_LEVEL = real(0, nullable=True)
STATIONS = Contract("stations", {"station_id": text(unique=True), "station_name": text(), "operator": text(isin=("EEA", "XVPCA")), "lon": LON, "lat": LAT, "year": whole(2018, 2030), "no2_annual_ugm3": _LEVEL, "pm25_annual_ugm3": _LEVEL, "pm10_annual_ugm3": _LEVEL, "o3_8h_max_ugm3": _LEVEL})
AIR_GRID = Contract("air_grid", {"lon": LON, "lat": LAT, "month": text(pattern=r"^\d{4}-\d{2}$"), "no2_ugm3": real(0), "pm25_ugm3": real(0)})
THERMAL = Contract("thermal", {"lon": LON, "lat": LAT, "year": whole(2018, 2030), "lst_summer_median_c": real(-10, 70), "uhi_delta_c": real(-10, 20)})
PROTECTED = Contract("protected_area", {"wdpa_id": text(unique=True), "name": text(), "designation": text(), "iucn_category": text(nullable=True), "geometry": text()})
OBSERVATIONS = Contract("observation", {"observation_id": text(unique=True), "source": text(isin=("inaturalist", "gbif")), "lon": LON, "lat": LAT, "year": whole(2010, 2030), "taxon_kingdom": text(nullable=True), "research_grade": Field("boolean", nullable=True)})
_DISTANCE = real(0, nullable=True)
CELLS = Contract(
    "cells",
    {"cell": text(unique=True, length=(15, 15)), "lon_centroid": LON, "lat_centroid": LAT}
    | {c: _DISTANCE for c in ("train_reach_min", "climb_min_m", "yoga_min_m", "hospital_min_m", "pharmacy_density_per_km2", "green_min_m", "sea_min_m", "biodiversity_obs_density", "industry_density_per_km2", "eprtr_facility_min_m", "no2_ugm3", "pm25_ugm3", "viirs_radiance", "mitma_inflow_daily", "mitma_outflow_daily")}
    | {c: whole(0, nullable=True) for c in ("trains_per_day_nearest", "trains_to_bcn_nearest")}
    | {c: Field("boolean", nullable=True) for c in ("natura2000_within_5km", "motorway_within_500m")}
    | {c: real(nullable=True) for c in ("lst_summer_median_c", "uhi_delta_c", "mitma_through_ratio")}
    | {"tree_cover_pct": real(0, 100, nullable=True), "liveability_score": real(0, 100, nullable=True)},
)
REGISTRY = {c.name: c for c in (OD_DAILY, OD_HOURLY, ZONES, POI, NETWORK, STOPS, FREQUENCY, STATIONS, AIR_GRID, THERMAL, PROTECTED, OBSERVATIONS, CELLS)}
