"""All registered queries of the mobility engine and their SQL equivalents.

Each query applies one operator to the test tables (see flowgrid.sources.cube for the mapping); each
oracle is the same computation written as DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.contracts import Contract, real, text, whole
from flowgrid.functions import display, geo
from flowgrid.operators import combine, flows, places, score, spatial, stats, transit
from flowgrid.sources import reach
from flowgrid.sources.cube import CUBE_SQL, crosswalk, od_cube, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded; adding 0.0 makes -0.0 plain."""
    return frame.select(*[(F.round(c.name, places) + 0.0).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in frame.schema.fields])


def silver(spark: SparkSession, d: str) -> DataFrame:
    return flows.silver(od_cube(spark, d))


def cube_sql(body: str) -> str:
    return f"WITH {CUBE_SQL}{body}"


def over(column: str, places: int = 6) -> str:
    return f"round({column}, {places}) + 0.0 AS {column}"


# Scans, silver, contracts


@register("scan_prefix_filter", cube_sql("""SELECT origin, dest, count(*) AS n, round(sum(trips), 4) AS trips FROM cube
WHERE substr(origin, 1, 2) IN ('00', '03') OR substr(dest, 1, 2) IN ('00', '03') GROUP BY ALL"""))  # fmt: skip
def scan_prefix_filter(spark, d):
    kept = od_cube(spark, d).where(flows.endpoint_prefix(["00", "03"]))
    return rounded(kept.groupBy("origin", "dest").agg(F.count("*").alias("n"), F.sum("trips").alias("trips")), 4)


@register("scan_day_window", cube_sql("""SELECT day, count(*) AS n, round(sum(trip_km), 2) AS trip_km FROM cube
WHERE day BETWEEN '19960115' AND '19970320' GROUP BY day"""))  # fmt: skip
def scan_day_window(spark, d):
    kept = od_cube(spark, d).where(flows.day_window("19960115", "19970320"))
    return rounded(kept.groupBy("day").agg(F.count("*").alias("n"), F.sum("trip_km").alias("trip_km")), 2)


@register("silver_enrich", cube_sql("SELECT day, hour, origin, dest, band, act_o, act_d, income, age, sex, date, weekday, is_weekend, season, trips FROM silver"))
def silver_enrich(spark, d):
    return silver(spark, d).select("day", "hour", "origin", "dest", "band", "act_o", "act_d", "income", "age", "sex", "date", "weekday", "is_weekend", "season", "trips")


@register("daily_rollup", cube_sql("""SELECT day, origin, dest, band, act_o, act_d, income, age, sex, date, weekday, is_weekend,
round(sum(trips), 4) AS trips, round(sum(trip_km), 2) AS trip_km, CAST(sum(support) AS BIGINT) AS support FROM silver GROUP BY ALL"""))  # fmt: skip
def daily_rollup(spark, d):
    return flows.daily_rollup(silver(spark, d)).withColumns({"trips": F.round("trips", 4), "trip_km": F.round("trip_km", 2)})


PROBE = Contract(
    "probe",
    {
        "o_orderkey": whole(0, unique=True), "o_custkey": whole(0, unique=True), "o_orderstatus": text(isin=("F", "O")),
        "o_totalprice": real(1000, 300000), "o_orderpriority": text(pattern="^[1-4]-", length=(5, 12)), "o_clerk": text(required=True),
    },
)


@register("contract_report", """
WITH r AS (SELECT count(*) AS n,
  count_if(o_orderkey < 0) AS k1, count_if(o_custkey < 0) AS k2, count_if(o_orderstatus NOT IN ('F', 'O')) AS s,
  count_if(o_totalprice < 1000 OR o_totalprice > 300000) AS p, count_if(NOT regexp_matches(o_orderpriority, '^[1-4]-')) AS q,
  count_if(length(o_orderpriority) < 5 OR length(o_orderpriority) > 12) AS l,
  count_if(o_orderkey IS NULL) AS z1, count_if(o_custkey IS NULL) AS z2, count_if(o_orderstatus IS NULL) AS z3, count_if(o_totalprice IS NULL) AS z4, count_if(o_orderpriority IS NULL) AS z5
  FROM orders),
u1 AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)),
u2 AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1))
SELECT x.c AS "column", x.r AS rule, CAST(x.n AS BIGINT) AS rows FROM r, u1, u2, LATERAL (VALUES
  ('o_orderkey', 'type', 0), ('o_orderkey', 'null', r.z1), ('o_orderkey', 'range', r.k1), ('o_custkey', 'type', 0), ('o_custkey', 'null', r.z2), ('o_custkey', 'range', r.k2),
  ('o_orderstatus', 'type', 0), ('o_orderstatus', 'null', r.z3), ('o_orderstatus', 'domain', r.s), ('o_totalprice', 'type', 0), ('o_totalprice', 'null', r.z4), ('o_totalprice', 'range', r.p),
  ('o_orderpriority', 'type', 0), ('o_orderpriority', 'null', r.z5), ('o_orderpriority', 'pattern', r.q), ('o_orderpriority', 'length', r.l), ('o_clerk', 'missing', r.n),
  ('o_orderkey', 'unique', u1.n), ('o_custkey', 'unique', u2.n)) AS x(c, r, n)""")  # fmt: skip
def contract_report(spark, d):
    return PROBE.report(read(spark, d, "orders"))


# Disaggregation


@register("xwalk_closure", cube_sql(""", s AS (SELECT zone, sum(weight) AS s FROM xwalk GROUP BY zone)
SELECT count(*) AS zones, round(min(s), 9) AS least, round(max(s), 9) AS greatest, round(avg(s), 9) AS mean, round(median(s), 9) AS median FROM s"""))  # fmt: skip
def xwalk_closure(spark, d):
    return rounded(flows.closure(crosswalk(spark, d)), 9)


FLOWS_SQL = """, days AS (SELECT count(DISTINCT day) AS n FROM silver),
i AS (SELECT dest AS zone, sum(trips) AS v FROM silver GROUP BY dest), o AS (SELECT origin AS zone, sum(trips) AS v FROM silver GROUP BY origin),
z AS (SELECT coalesce(i.zone, o.zone) AS zone, coalesce(i.v, 0) / n AS inflow, coalesce(o.v, 0) / n AS outflow FROM i FULL JOIN o ON i.zone = o.zone CROSS JOIN days),
c AS (SELECT cell, sum(inflow * weight) AS inflow, sum(outflow * weight) AS outflow FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY cell)
"""


@register("inflow_outflow", cube_sql(FLOWS_SQL + """SELECT cell, round(inflow, 6) AS inflow, round(outflow, 6) AS outflow,
round(CASE WHEN inflow > 0 THEN outflow / inflow END, 6) AS through, round(ln(greatest(outflow, 1) / greatest(inflow, 1)), 6) + 0.0 AS log_through FROM c"""))  # fmt: skip
def inflow_outflow(spark, d):
    return rounded(flows.inflow_outflow(silver(spark, d), crosswalk(spark, d)))


@register("inflow_outflow_mean", cube_sql(""",
i AS (SELECT zone, avg(v) AS v FROM (SELECT dest AS zone, day, sum(trips) AS v FROM silver GROUP BY ALL) GROUP BY zone),
o AS (SELECT zone, avg(v) AS v FROM (SELECT origin AS zone, day, sum(trips) AS v FROM silver GROUP BY ALL) GROUP BY zone),
z AS (SELECT coalesce(i.zone, o.zone) AS zone, coalesce(i.v, 0) AS a, coalesce(o.v, 0) AS b FROM i FULL JOIN o ON i.zone = o.zone),
c AS (SELECT cell, sum(a * weight) AS inflow, sum(b * weight) AS outflow FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY cell)
SELECT cell, round(inflow, 6) AS inflow, round(outflow, 6) AS outflow, round(ln((outflow + 1) / (inflow + 1)), 6) + 0.0 AS log_through FROM c"""))  # fmt: skip
def inflow_outflow_mean(spark, d):
    return rounded(flows.inflow_outflow_mean(silver(spark, d), crosswalk(spark, d)))


@register("disagg_ratio", cube_sql(""", z AS (SELECT dest AS zone, sum(trip_km) AS km, sum(trips) AS trips FROM silver GROUP BY dest)
SELECT cell, round(sum(km * weight) / sum(trips * weight), 6) AS km_per_trip FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY cell"""))  # fmt: skip
def disagg_ratio(spark, d):
    zones = silver(spark, d).groupBy(F.col("dest").alias("zone")).agg(F.sum("trip_km").alias("km"), F.sum("trips").alias("trips"))
    return rounded(flows.spread_ratios(zones, crosswalk(spark, d), {"km_per_trip": ("km", "trips")}).select("cell", "km_per_trip"))


@register("disagg_weighted_avg", cube_sql(""", z AS (SELECT dest AS zone, CASE WHEN CAST(substr(dest, 3) AS INTEGER) % 4 <> 0 THEN avg(trips) END AS v FROM silver GROUP BY dest)
SELECT cell, round(sum(v * weight) / sum(CASE WHEN v IS NOT NULL THEN weight END), 6) AS v FROM xwalk LEFT JOIN z ON z.zone = xwalk.zone GROUP BY cell"""))  # fmt: skip
def disagg_weighted_avg(spark, d):
    some = F.col("zone").substr(3, 3).cast("int") % 4 != 0
    zones = silver(spark, d).groupBy(F.col("dest").alias("zone")).agg(F.avg("trips").alias("v")).withColumn("v", F.when(some, F.col("v")))
    return rounded(flows.spread_average(zones, crosswalk(spark, d), ["v"]))


@register("disagg_categorical", cube_sql(""", z AS (SELECT zone, band FROM (SELECT dest AS zone, band, row_number() OVER (PARTITION BY dest ORDER BY sum(trips) DESC, band DESC) AS r FROM silver GROUP BY dest, band) WHERE r = 1)
SELECT cell, band FROM (SELECT cell, band, row_number() OVER (PARTITION BY cell ORDER BY weight DESC, z.zone DESC) AS r FROM xwalk JOIN z ON z.zone = xwalk.zone) WHERE r = 1"""))  # fmt: skip
def disagg_categorical(spark, d):
    sums = silver(spark, d).groupBy(F.col("dest").alias("zone"), "band").agg(F.sum("trips").alias("t"))
    zones = sums.groupBy("zone").agg(F.max_by("band", F.struct("t", "band")).alias("band"))
    return flows.spread_label(zones, crosswalk(spark, d), "band")


@register("dominant_cell", cube_sql("SELECT zone, cell, round(weight, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY weight DESC, cell) AS r FROM xwalk) WHERE r = 1"))
def dominant_cell(spark, d):
    return rounded(flows.dominant_cells(crosswalk(spark, d)), 9)


@register("centroid_totals", cube_sql(""", i AS (SELECT dest AS zone, sum(trips) AS v FROM silver GROUP BY dest), o AS (SELECT origin AS zone, sum(trips) AS v FROM silver GROUP BY origin)
SELECT cell, xwalk.zone, round(i.v, 4) AS inflow, round(o.v, 4) AS outflow FROM xwalk LEFT JOIN i ON i.zone = xwalk.zone LEFT JOIN o ON o.zone = xwalk.zone"""))  # fmt: skip
def centroid_totals(spark, d):
    return rounded(flows.centroid_totals(silver(spark, d), crosswalk(spark, d)), 4)


# Rhythm


def rhythm_sql(keys: str, bands: str, parts: str, where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return cube_sql(f""", z AS (SELECT dest AS zone, {k}hour, sum(trips) AS v FROM silver WHERE {where} GROUP BY ALL),
h AS (SELECT cell, {k}hour, sum(v * weight) AS flow FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY ALL),
s AS (SELECT *, flow / sum(flow) OVER (PARTITION BY cell{', ' + keys if keys else ''}) AS share FROM h),
g AS (SELECT cell, {k}{bands}, max_by(hour, (round(flow, 9), -hour)) AS peak_hour FROM s GROUP BY ALL)
SELECT *, CASE {parts} ELSE 'night' END AS peak_part FROM g""")


def _bands(am, pm, mid) -> str:
    one = lambda test, name: f"round(sum(CASE WHEN {test} THEN share ELSE 0 END), 6) AS {name}"
    return ", ".join([one(f"hour BETWEEN {am}", "am_peak_share"), one(f"hour BETWEEN {pm}", "pm_peak_share"), one(f"hour BETWEEN {mid}", "midday_share"), one("hour <= 5 OR hour >= 22", "night_share")])


NARROW = _bands("7 AND 9", "17 AND 19", "11 AND 15")
PARTS = "WHEN peak_hour BETWEEN 5 AND 10 THEN 'morning' WHEN peak_hour BETWEEN 11 AND 15 THEN 'midday' WHEN peak_hour BETWEEN 16 AND 19 THEN 'evening'"


def steady(shares: DataFrame) -> DataFrame:
    """Flows rounded, so that peaks don't hang on the order of a sum."""
    return shares.withColumn("flow", F.round("flow", 9))


@register("hourly_rhythm", rhythm_sql("", NARROW, PARTS))
def hourly_rhythm(spark, d):
    return rounded(flows.hourly_rhythm(silver(spark, d), crosswalk(spark, d)))


@register("hourly_rhythm_wide", rhythm_sql("", _bands("7 AND 9", "17 AND 20", "11 AND 14"), PARTS.replace("5 AND 10", "6 AND 10").replace("16 AND 19", "16 AND 21")))
def hourly_rhythm_wide(spark, d):
    return rounded(flows.hourly_rhythm(silver(spark, d), crosswalk(spark, d), bands=flows.WIDE_BANDS, parts=flows.WIDE_PARTS))


@register("hourly_rhythm_seasonal", rhythm_sql("season", NARROW, PARTS, "season IS NOT NULL"))
def hourly_rhythm_seasonal(spark, d):
    od = silver(spark, d).where("season is not null")
    return rounded(flows.hourly_rhythm(od, crosswalk(spark, d), ["season"]))


LONG_SQL = """, z AS (SELECT dest AS zone, hour, sum(trips) AS v FROM silver GROUP BY ALL),
h AS (SELECT cell, hour, sum(v * weight) AS flow FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY ALL)
"""


@register("rhythm_long", cube_sql(LONG_SQL + "SELECT cell, hour, round(flow / sum(flow) OVER (PARTITION BY cell), 4) AS share FROM h"))
def rhythm_long(spark, d):
    return rounded(flows.hour_shares(silver(spark, d), crosswalk(spark, d)).select("cell", "hour", "share"), 4)


@register("hour_vector", cube_sql(LONG_SQL + """SELECT c.cell, CAST(s.slot AS INTEGER) AS slot, round(coalesce(h.flow / t.total, 0), 6) AS share FROM (SELECT DISTINCT cell FROM h) c
CROSS JOIN (SELECT unnest(range(24)) AS slot) s JOIN (SELECT cell, sum(flow) AS total FROM h GROUP BY cell) t ON t.cell = c.cell LEFT JOIN h ON h.cell = c.cell AND h.hour = s.slot"""))  # fmt: skip
def hour_vector(spark, d):
    profile = flows.hour_vector(flows.hour_shares(silver(spark, d), crosswalk(spark, d)))
    return rounded(profile.select("cell", F.posexplode("profile").alias("slot", "share")))


# Weekends


def weekend_sql(keys: str, score_sql: str, gate: bool = False, where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return cube_sql(f""", dy AS (SELECT dest AS zone, {k}day, is_weekend, sum(trips) AS v, sum(support) AS n,
  sum(CASE WHEN act_d IN ('frecuente', 'no_frecuente') THEN trips ELSE 0 END) AS leisure, sum(CASE WHEN act_d = 'trabajo_estudio' THEN trips ELSE 0 END) AS commute
  FROM silver WHERE {where} GROUP BY ALL),
z AS (SELECT zone, {k}coalesce(avg(CASE WHEN is_weekend THEN v END), 0) AS we, coalesce(avg(CASE WHEN NOT is_weekend THEN v END), 0) AS wd, CAST(sum(n) AS DOUBLE) AS n,
  sum(leisure) AS leisure, sum(commute) AS commute, sum(v) AS total, coalesce(sum(CASE WHEN NOT is_weekend THEN v END), 0) AS wdt FROM dy GROUP BY ALL),
c AS (SELECT cell, {k}sum(we * weight) AS we, sum(wd * weight) AS wd, sum(n * weight) AS n, sum(leisure * weight) AS leisure, sum(commute * weight) AS commute,
  sum(total * weight) AS total, sum(wdt * weight) AS wdt FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY ALL),
r AS (SELECT *, CASE WHEN wd > 0 THEN we / wd END AS ratio, CASE WHEN total > 0 THEN leisure / total END AS ls, CASE WHEN total > 0 THEN commute / total END AS cs FROM c)
SELECT cell, {k}{'' if gate else 'round(n, 6) AS support_n, '}round(ratio, 6) AS weekend_ratio, round(ls, 6) AS leisure_share, {'round(wdt, 6) AS weekday_trips' if gate else 'round(cs, 6) AS commute_share'},
round({score_sql}, 6) AS hotspot_score FROM r""")


@register("weekend_hotspots", weekend_sql("", "CASE WHEN n >= 5 THEN ratio * (0.5 + ls) END"))
def weekend_hotspots(spark, d):
    return rounded(flows.weekend_hotspots(silver(spark, d), crosswalk(spark, d), min_support=5))


SEASONAL_HOTSPOTS = weekend_sql("season", "CASE WHEN n >= 5 THEN ratio * (0.5 + ls) END", where="season IS NOT NULL")


def _seasonal(spark, d):
    return flows.weekend_hotspots(silver(spark, d).where("season is not null"), crosswalk(spark, d), keys=["season"], min_support=5)


@register("weekend_hotspots_seasonal", SEASONAL_HOTSPOTS)
def weekend_hotspots_seasonal(spark, d):
    return rounded(_seasonal(spark, d))


@register("weekend_hotspots_gated", weekend_sql("", "CASE WHEN wdt >= 100 THEN ratio * (1 + coalesce(ls, 0)) END", gate=True))
def weekend_hotspots_gated(spark, d):
    return rounded(flows.weekend_hotspots_gated(silver(spark, d), crosswalk(spark, d)))


@register("seasonal_wide_delta", f"""WITH s AS ({SEASONAL_HOTSPOTS}), w AS (SELECT cell,
  max(CASE WHEN season = 'feb' THEN weekend_ratio END) AS weekend_ratio_feb, max(CASE WHEN season = 'may' THEN weekend_ratio END) AS weekend_ratio_may, max(CASE WHEN season = 'jun' THEN weekend_ratio END) AS weekend_ratio_jun,
  max(CASE WHEN season = 'feb' THEN leisure_share END) AS leisure_share_feb, max(CASE WHEN season = 'may' THEN leisure_share END) AS leisure_share_may, max(CASE WHEN season = 'jun' THEN leisure_share END) AS leisure_share_jun
  FROM s GROUP BY cell)
SELECT *, round(weekend_ratio_jun - weekend_ratio_feb, 6) + 0.0 AS weekend_ratio_delta, round(leisure_share_jun - leisure_share_feb, 6) + 0.0 AS leisure_share_delta FROM w""")  # fmt: skip
def seasonal_wide_delta(spark, d):
    return rounded(flows.seasonal_wide(rounded(_seasonal(spark, d)), ["weekend_ratio", "leisure_share"]))


# Who travels, typology


_GEO = {
    "female": "sex = 'mujer'", "youth": "age = '0-25'", "senior": "age = '65-100'", "low_income": "income = '<10'",
    "known_sex": "sex IN ('hombre', 'mujer')", "known_age": "age <> 'NA'", "known_income": "income <> 'NA'", "total": "true",
}


@register("geodemographic", cube_sql(f""", z AS (SELECT dest AS zone, {', '.join(f"sum(CASE WHEN {t} THEN trips ELSE 0 END) AS {k}" for k, t in _GEO.items())} FROM silver GROUP BY dest),
c AS (SELECT cell, {', '.join(f"sum({k} * weight) AS {k}" for k in _GEO)} FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY cell)
SELECT cell, {', '.join(f"round(CASE WHEN {b} > 0 THEN {a} / {b} END, 6) AS {k}" for k, (a, b) in flows.GEODEMO.items())} FROM c"""))  # fmt: skip
def geodemographic(spark, d):
    return rounded(flows.geodemographic(silver(spark, d), crosswalk(spark, d)))


@register("geodemo_entropy", cube_sql(""", z AS (SELECT dest AS zone, income, age, sum(trips) AS n FROM silver GROUP BY ALL),
c AS (SELECT cell, income, age, sum(n * weight) AS n FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY ALL), p AS (SELECT cell, n / sum(n) OVER (PARTITION BY cell) AS p FROM c)
SELECT cell, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) + 0.0 AS diversity FROM p GROUP BY cell"""))  # fmt: skip
def geodemo_entropy(spark, d):
    return rounded(flows.entropy_bits(silver(spark, d), crosswalk(spark, d)))


@register("entropy_by_zone", cube_sql(""", z AS (SELECT dest AS zone, income, age, sum(trips) AS n FROM silver GROUP BY ALL), p AS (SELECT zone, n / sum(n) OVER (PARTITION BY zone) AS p FROM z),
e AS (SELECT zone, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS e FROM p GROUP BY zone)
SELECT cell, round(sum(e * weight) / sum(CASE WHEN e IS NOT NULL THEN weight END), 6) AS diversity FROM xwalk LEFT JOIN e ON e.zone = xwalk.zone GROUP BY cell"""))  # fmt: skip
def entropy_by_zone(spark, d):
    return rounded(flows.entropy_by_zone(silver(spark, d), crosswalk(spark, d)))


@register("typology_indices", cube_sql(""", i AS (SELECT dest AS zone, sum(trips) AS t, sum(CASE WHEN origin = dest THEN trips ELSE 0 END) AS a, sum(CASE WHEN band IN ('50-100', '>100') THEN trips ELSE 0 END) AS l,
  sum(CASE WHEN act_d IN ('frecuente', 'no_frecuente') THEN trips ELSE 0 END) AS e, sum(CASE WHEN act_d = 'trabajo_estudio' THEN trips ELSE 0 END) AS m FROM silver GROUP BY dest),
o AS (SELECT origin AS zone, sum(trips) AS o FROM silver GROUP BY origin),
z AS (SELECT coalesce(i.zone, o.zone) AS zone, coalesce(t, 0) AS t, coalesce(a, 0) AS a, coalesce(l, 0) AS l, coalesce(e, 0) AS e, coalesce(m, 0) AS m, coalesce(o, 0) AS o FROM i FULL JOIN o ON i.zone = o.zone),
c AS (SELECT cell, sum(t * weight) AS t, sum(a * weight) AS a, sum(l * weight) AS l, sum(e * weight) AS e, sum(m * weight) AS m, sum(o * weight) AS o FROM z JOIN xwalk ON z.zone = xwalk.zone GROUP BY cell)
SELECT cell, round(CASE WHEN t > 0 THEN a / t END, 6) AS intra_share, round(CASE WHEN t > 0 THEN l / t END, 6) AS long_share, round(CASE WHEN t > 0 THEN e / t END, 6) AS leisure_share,
round(CASE WHEN t > 0 THEN m / t END, 6) AS commute_share, round(ln(greatest(o, 1) / greatest(t, 1)), 6) + 0.0 AS sink_source FROM c"""))  # fmt: skip
def typology_indices(spark, d):
    return rounded(flows.typology_indices(silver(spark, d), crosswalk(spark, d)))


@register("typology_kmeans")
def typology_kmeans(spark, d):
    return flows.typology(flows.typology_indices(silver(spark, d), crosswalk(spark, d)))


# Corridors and slices


def centroids(spark, d):
    """Zones with coordinates made from their codes."""
    code = F.col("zone").substr(3, 3).cast("int")
    return crosswalk(spark, d).select("zone").distinct().select("zone", (0.2 + code * 0.1).alias("lon"), (40.6 + code * 0.05).alias("lat"))


def arcs_sql(top: int, test: str) -> str:
    return cube_sql(f""", k AS (SELECT * FROM silver WHERE origin <> dest AND {test}), n AS (SELECT count(DISTINCT day) AS n FROM k),
p AS (SELECT origin, dest, sum(trips) / n AS v FROM k, n GROUP BY origin, dest, n ORDER BY v DESC, origin, dest LIMIT {top})
SELECT origin, dest, round(CAST(0.2 + CAST(substr(origin, 3) AS INTEGER) * 0.1 AS DOUBLE), 5) AS o_lon, round(CAST(40.6 + CAST(substr(origin, 3) AS INTEGER) * 0.05 AS DOUBLE), 5) AS o_lat,
round(CAST(0.2 + CAST(substr(dest, 3) AS INTEGER) * 0.1 AS DOUBLE), 5) AS d_lon, round(CAST(40.6 + CAST(substr(dest, 3) AS INTEGER) * 0.05 AS DOUBLE), 5) AS d_lat, round(v, 1) AS value FROM p""")


@register("od_arcs", arcs_sql(200, "true"))
def od_arcs(spark, d):
    return flows.arcs(flows.corridors(silver(spark, d), 200), centroids(spark, d))


@register("od_arcs_weekend", arcs_sql(100, "is_weekend"))
def od_arcs_weekend(spark, d):
    return flows.arcs(flows.corridors(silver(spark, d), 100, weekend=True), centroids(spark, d))


SLICES_SQL = """, k AS (SELECT *, CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day_type FROM silver WHERE origin <> dest AND season IS NOT NULL),
n AS (SELECT season, day_type, count(DISTINCT day) AS n FROM k GROUP BY ALL),
p AS (SELECT season, day_type, origin, dest, sum(trips) AS t FROM k GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, day_type ORDER BY t DESC, origin, dest) AS r FROM p) WHERE r <= 40),
h AS (SELECT season, day_type, origin, dest, hour, sum(trips) AS t FROM k GROUP BY ALL)
"""


@register("od_slices_topn", cube_sql(SLICES_SQL + """SELECT b.season, b.day_type, b.origin, b.dest, round(b.t / n, 2) AS trips_day, CAST(s.slot AS INTEGER) AS slot, round(coalesce(h.t, 0) / n, 2) AS flow
FROM b JOIN n USING (season, day_type) CROSS JOIN (SELECT unnest(range(24)) AS slot) s
LEFT JOIN h ON h.season = b.season AND h.day_type = b.day_type AND h.origin = b.origin AND h.dest = b.dest AND h.hour = s.slot"""))  # fmt: skip
def od_slices_topn(spark, d):
    return flows.slices(silver(spark, d), 40).select("season", "day_type", "origin", "dest", "trips_day", F.posexplode("hourly").alias("slot", "flow"))


@register("slice_locations", cube_sql(SLICES_SQL + "SELECT origin AS zone FROM b UNION SELECT dest FROM b"))
def slice_locations(spark, d):
    return flows.slice_locations(flows.slices(silver(spark, d), 40))


@register("hour_reweight", cube_sql(SLICES_SQL + """SELECT b.season, b.day_type, b.origin, b.dest, round(coalesce(h.t, 0) / n, 2) AS count FROM b JOIN n USING (season, day_type)
LEFT JOIN h ON h.season = b.season AND h.day_type = b.day_type AND h.origin = b.origin AND h.dest = b.dest AND h.hour = 8"""))  # fmt: skip
def hour_reweight(spark, d):
    return flows.at_hour(flows.slices(silver(spark, d), 40), 8).select("season", "day_type", "origin", "dest", "count")


@register("location_totals", cube_sql(""", e AS (SELECT origin AS zone, CASE WHEN origin <> dest THEN trips ELSE 0 END AS l, 0.0 AS r, CASE WHEN origin = dest THEN trips ELSE 0 END AS s FROM cube
UNION ALL SELECT dest, 0.0, CASE WHEN origin <> dest THEN trips ELSE 0 END, 0.0 FROM cube)
SELECT zone, round(sum(l), 4) AS leaving, round(sum(r), 4) AS reaching, round(sum(s), 4) AS staying FROM e GROUP BY zone"""))  # fmt: skip
def location_totals(spark, d):
    return rounded(flows.location_totals(od_cube(spark, d)), 4)


@register("parent_flows", cube_sql("SELECT substr(origin, 1, 2) AS from_parent, substr(dest, 1, 2) AS to_parent, round(sum(trips), 4) AS trips FROM cube GROUP BY ALL"))
def parent_flows(spark, d):
    return rounded(flows.parent_flows(od_cube(spark, d)), 4)


@register("flow_domains", cube_sql(SLICES_SQL + "SELECT season, round(min(t / n), 2) AS lo, round(max(t / n), 2) AS hi FROM b JOIN n USING (season, day_type) GROUP BY season"))
def flow_domains(spark, d):
    return flows.domains(flows.slices(silver(spark, d), 40), "trips_day", ["season"])


# Descriptive statistics


DAY = "CAST(strptime(day, '%Y%m%d') AS DATE)"
NAMES_SQL = ", wd AS (SELECT * FROM (VALUES ('mon', 0), ('tue', 1), ('wed', 2), ('thu', 3), ('fri', 4), ('sat', 5), ('sun', 6)) AS t(weekday_name, n))"
NAMED = f"(SELECT cube.*, weekday_name FROM cube JOIN wd ON isodow({DAY}) - 1 = wd.n)"


@register("weekday_totals", cube_sql(f"""{NAMES_SQL}, dy AS (SELECT day, weekday_name, sum(trips) AS t FROM {NAMED} GROUP BY ALL)
SELECT wd.n, wd.weekday_name, round(avg(t), 4) AS mean_trips FROM wd LEFT JOIN dy ON dy.weekday_name = wd.weekday_name GROUP BY ALL"""))  # fmt: skip
def weekday_totals(spark, d):
    return rounded(stats.weekday_totals(od_cube(spark, d)), 4)


@register("hourly_profile", cube_sql(f"""{NAMES_SQL}, q AS (SELECT weekday_name, {', '.join(f"round(sum(CASE WHEN hour = {h} THEN trips ELSE 0 END), 4) AS h{h}" for h in range(24))} FROM {NAMED} GROUP BY weekday_name)
SELECT wd.n, wd.weekday_name, {', '.join(f"coalesce(h{h}, 0) AS h{h}" for h in range(24))} FROM wd LEFT JOIN q ON q.weekday_name = wd.weekday_name"""))  # fmt: skip
def hourly_profile(spark, d):
    return rounded(stats.hourly_profile(od_cube(spark, d)), 4)


@register("peak_hour_corridor", cube_sql(""", h AS (SELECT origin, dest, hour, sum(trips) AS t FROM cube GROUP BY ALL)
SELECT origin, dest, round(sum(t), 4) AS trips, max_by(hour, (t, -hour)) AS peak_hour FROM h GROUP BY origin, dest ORDER BY sum(t) DESC, origin, dest LIMIT 20"""))  # fmt: skip
def peak_hour_corridor(spark, d):
    return rounded(stats.peak_hours(od_cube(spark, d)), 4)


@register("anomaly_days", cube_sql(""", t AS (SELECT day, sum(trips) AS trips FROM cube GROUP BY day), m AS (SELECT avg(trips) AS a, stddev_samp(trips) AS s FROM t)
SELECT day, round(trips, 4) AS trips, round((trips - a) / s, 6) AS z_score FROM t, m WHERE abs((trips - a) / s) > 2"""))  # fmt: skip
def anomaly_days(spark, d):
    return stats.anomalies(od_cube(spark, d), 2.0).withColumns({"trips": F.round("trips", 4), "z_score": F.round("z_score", 6)})


@register("distance_band_share", cube_sql(""", t AS (SELECT is_weekend, band, sum(trips) AS trips FROM silver GROUP BY ALL)
SELECT is_weekend, band, round(trips, 4) AS trips, round(trips / sum(trips) OVER (PARTITION BY is_weekend), 6) AS share FROM t"""))  # fmt: skip
def distance_band_share(spark, d):
    return stats.shares_within(silver(spark, d), "is_weekend", "band").withColumns({"trips": F.round("trips", 4), "share": F.round("share", 6)})


ACTS = ("casa", "trabajo_estudio", "frecuente", "no_frecuente")


@register("activity_matrix", cube_sql(f"""SELECT act_o, {', '.join(f"round(coalesce(sum(CASE WHEN act_d = '{a}' THEN trips END), 0), 4) AS {a}" for a in ACTS)} FROM cube GROUP BY act_o"""))
def activity_matrix(spark, d):
    return rounded(stats.cross_totals(od_cube(spark, d), "act_o", "act_d", ACTS), 4)


@register("province_weekday", cube_sql(f"""{NAMES_SQL}, t AS (SELECT day, weekday_name, origin, sum(trips) AS t FROM {NAMED} GROUP BY ALL)
SELECT substr(origin, 1, 2) AS province, {', '.join(f"round(avg(CASE WHEN weekday_name = '{w}' THEN t END), 4) AS {w}" for w in stats.WEEKDAYS)} FROM t GROUP BY ALL"""))  # fmt: skip
def province_weekday(spark, d):
    return rounded(stats.province_weekdays(od_cube(spark, d)), 4)


@register("daily_series", cube_sql("SELECT day, round(sum(trips), 4) AS trips FROM cube GROUP BY day"))
def daily_series(spark, d):
    return rounded(stats.daily_series(od_cube(spark, d)), 4)


@register("peak_hour_hist", cube_sql(""", h AS (SELECT origin, dest, hour, sum(trips) AS t FROM cube GROUP BY ALL), p AS (SELECT origin, dest, max_by(hour, (t, -hour)) AS peak FROM h GROUP BY ALL),
c AS (SELECT peak, count(*) AS n FROM p GROUP BY peak) SELECT CAST(s.hour AS INTEGER) AS hour, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) s LEFT JOIN c ON c.peak = s.hour"""))  # fmt: skip
def peak_hour_hist(spark, d):
    return stats.histogram_of_hours(stats.corridor_peaks(od_cube(spark, d)), "peak_hour")


# A wide table of cells, made from the customers

_K = "c_custkey"
CELL_FEATURES = {
    "train_reach_min": ("{k} % 5 <> 0", "({k} * 7) % 40", "double"), "trains_to_bcn_nearest": ("{k} % 7 <> 0", "({k} * 11) % 90", "double"),
    "climb_min_m": ("{k} % 3 <> 0", "({k} * 131) % 15000", "double"), "yoga_min_m": ("{k} % 4 <> 0", "({k} * 173) % 12000", "double"),
    "green_min_m": ("{k} % 11 <> 0", "({k} * 97) % 9000", "double"), "hospital_min_m": ("{k} % 6 <> 0", "({k} * 211) % 20000", "double"),
    "sea_min_m": ("{k} % 2 = 0", "({k} * 59) % 8000", "double"), "tree_cover_pct": ("true", "({k} * 13) % 101", "double"),
    "natura2000_within_5km": ("{k} % 9 <> 0", "{k} % 2", "boolean"), "biodiversity_obs_density": ("{k} % 8 <> 0", "({k} * 3) % 50", "double"),
    "no2_ugm3": ("{k} % 2 = 1", "({k} * 5) % 45", "double"), "pm25_ugm3": ("{k} % 5 = 1", "({k} * 3) % 20", "double"),
    "uhi_delta_c": ("true", "({k} % 9) - 3", "double"), "viirs_radiance": ("true", "({k} * 19) % 60", "double"),
    "industry_density_per_km2": ("true", "{k} % 3", "double"), "eprtr_facility_min_m": ("{k} % 10 <> 0", "({k} * 307) % 50000", "double"),
    "motorway_within_500m": ("true", "CASE WHEN {k} % 12 = 0 THEN 1 ELSE 0 END", "boolean"), "pharmacy_density_per_km2": ("true", "{k} % 6", "double"),
    "mitma_through_ratio": ("{k} % 13 <> 0", "({k} % 20) / 10.0", "double"),
}


def _features(keys: str, cast: Callable[[str, str], str]) -> str:
    return ", ".join(f"CASE WHEN {t.format(k=keys)} THEN {cast(v.format(k=keys), kind)} END AS {name}" for name, (t, v, kind) in CELL_FEATURES.items())


_SQL_CAST = lambda v, kind: f"CAST(({v}) AS {'BOOLEAN' if kind == 'boolean' else 'DOUBLE'})"
CELLS_SQL = f"cells AS (SELECT lower(lpad(upper(to_hex({_K})), 15, '0')) AS cell, {_K} AS k, c_mktsegment AS label, c_acctbal AS balance, {_features(_K, _SQL_CAST)} FROM customer)"


def cells(spark, d):
    frame = read(spark, d, "customer")
    made = [f"CASE WHEN {t.format(k=_K)} THEN {_SQL_CAST(v.format(k=_K), kind)} END AS {name}" for name, (t, v, kind) in CELL_FEATURES.items()]
    return frame.selectExpr(f"lower(lpad(hex({_K}), 15, '0')) AS cell", f"{_K} AS k", "c_mktsegment AS label", "c_acctbal AS balance", *made)


@register("coverage", f"""WITH {CELLS_SQL} SELECT f AS feature, round(c, 4) AS coverage FROM (SELECT {', '.join(f"avg(CAST({c} IS NOT NULL AS INTEGER)) AS {c}" for c in CELL_FEATURES)} FROM cells) UNPIVOT (c FOR f IN ({', '.join(CELL_FEATURES)}))""")
def coverage(spark, d):
    return stats.coverage(cells(spark, d), list(CELL_FEATURES))


_DESCRIBED = ("balance", "climb_min_m", "no2_ugm3", "viirs_radiance")


@register("describe_stats", f"WITH {CELLS_SQL} " + " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM cells""" for c in _DESCRIBED))  # fmt: skip
def describe_stats(spark, d):
    return rounded(stats.describe(cells(spark, d), _DESCRIBED))


@register("label_counts", f"""WITH {CELLS_SQL}, o AS (SELECT * FROM (VALUES ('BUILDING', 0), ('RETAIL', 1), ('MACHINERY', 2)) AS t(label, place)), c AS (SELECT label, count(*) AS n FROM cells GROUP BY label)
SELECT coalesce(o.label, c.label) AS label, coalesce(n, 0) AS n, CAST(coalesce(place, 3) AS INTEGER) AS place FROM o FULL JOIN c ON o.label = c.label""")  # fmt: skip
def label_counts(spark, d):
    return stats.label_counts(cells(spark, d), "label", ["BUILDING", "RETAIL", "MACHINERY"])


@register("regression_diff", f"""WITH {CELLS_SQL}, p AS (SELECT balance AS a, balance * 1.1 + k % 7 AS b FROM cells)
SELECT 'balance' AS feature, count(*) AS n, round(median(a), 6) AS median_old, round(median(b), 6) AS median_new, round(corr(a, b), 6) AS correlation,
round(median(abs(b - a) / CASE WHEN a <> 0 THEN abs(a) END), 6) AS median_change, count(DISTINCT b) AS distinct_new FROM p""")  # fmt: skip
def regression_diff(spark, d):
    old = cells(spark, d).select("cell", "k", "balance")
    new = old.select("cell", (F.col("balance") * 1.1 + F.col("k") % 7).alias("balance"))
    return rounded(stats.regression(old, new, "cell", ["balance"]))


@register("season_preflight", cube_sql(""", t AS (SELECT season, substr(day, 1, 4) AS y, count(DISTINCT day) AS days FROM silver WHERE season IS NOT NULL GROUP BY ALL),
e AS (SELECT *, CASE season WHEN 'feb' THEN 28 WHEN 'may' THEN 31 ELSE 30 END AS want FROM t)
SELECT season, CAST(sum(days) AS BIGINT) AS days, CAST(sum(want) AS BIGINT) AS expected, bool_and(days >= want) AS complete FROM e GROUP BY season"""))  # fmt: skip
def season_preflight(spark, d):
    return stats.season_days(silver(spark, d))


# Scores


def score_sql(preset: str) -> str:
    w = score.load_weights(preset)
    over0 = lambda c, floor: f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0, {c} - {floor}) END"
    near = lambda c: f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0, 1 - {c} / 10000.0) END"
    terms = {
        "train_reach_per_min_under25": "CASE WHEN train_reach_min IS NOT NULL THEN greatest(0.0, 25 - train_reach_min) END", "trains_to_bcn_per_30": "trains_to_bcn_nearest / 30.0",
        "climb_reward": near("climb_min_m"), "yoga_reward": near("yoga_min_m"), "green_reward": near("green_min_m"), "hospital_reward": near("hospital_min_m"),
        "sea_within_3km_bonus": "CASE WHEN sea_min_m < 3000 THEN 1 END", "tree_cover_pct": "tree_cover_pct", "natura2000_within_5km": "CASE WHEN natura2000_within_5km THEN 1 END",
        "biodiversity_obs_log": "ln(1 + biodiversity_obs_density)", "no2_above_who_per_ugm3": over0("no2_ugm3", 20), "pm25_above_who_per_ugm3": over0("pm25_ugm3", 5),
        "uhi_per_degree": over0("uhi_delta_c", 0), "viirs_radiance": "viirs_radiance", "industry_density": "industry_density_per_km2",
        "eprtr_inverse_dist": "CASE WHEN eprtr_facility_min_m > 0 THEN 1 / eprtr_facility_min_m END", "motorway_within_500m": "CASE WHEN motorway_within_500m THEN 1 END",
        "pharmacy_density_log": "ln(1 + pharmacy_density_per_km2)", "mitma_through_ratio": "mitma_through_ratio",
    }
    total = " + ".join([f"CAST({w['base_offset']} AS DOUBLE)"] + [f"coalesce({t}, 0) * CAST({w[k]} AS DOUBLE)" for k, t in terms.items()])
    return f"least(100.0, greatest(0.0, {total}))"


for _preset in score.PRESETS:

    @register(f"score_{_preset}", f"WITH {CELLS_SQL} SELECT cell, round({score_sql(_preset)}, 6) AS liveability_score FROM cells")
    def _scored(spark, d, preset=_preset):
        return rounded(score.with_score(cells(spark, d), preset).select("cell", "liveability_score"))


@register("score_sensitivity", f"""WITH {CELLS_SQL}, s AS ({' UNION ALL '.join(f"SELECT '{p}' AS p, cell, {score_sql(p)} AS s FROM cells" for p in score.PRESETS)}),
t AS (SELECT p, cell FROM (SELECT p, cell, row_number() OVER (PARTITION BY p ORDER BY round(s, 9) DESC, cell) AS r FROM s) WHERE r <= 10),
n AS (SELECT x.p AS a, y.p AS b, count(*) AS i FROM t x JOIN t y ON x.cell = y.cell GROUP BY ALL), q AS (SELECT DISTINCT p FROM t)
SELECT u.p AS a, v.p AS b, round(coalesce(i, 0) / (20.0 - coalesce(i, 0)), 3) AS jaccard FROM q u CROSS JOIN q v LEFT JOIN n ON n.a = u.p AND n.b = v.p""")  # fmt: skip
def score_sensitivity(spark, d):
    return score.sensitivity(cells(spark, d))


def _legacy_sql(near: float, green: float, hospital: float, wide: bool) -> str:
    """The first generation's score, written from its definition."""
    far = lambda c, cap, per: f"- coalesce(CASE WHEN {c} IS NOT NULL THEN least({c}, {cap}) END / {per}, 0)"  # least skips nulls
    more = """ + coalesce(CASE WHEN natura2000_within_5km THEN 5 END, 0) + coalesce(tree_cover_pct * CAST(0.15 AS DOUBLE), 0) + coalesce(ln(1 + biodiversity_obs_density), 0)
    - coalesce(greatest(no2_ugm3 - 20, 0) * CAST(0.5 AS DOUBLE), 0) - coalesce(greatest(pm25_ugm3 - 5, 0) * CAST(1.2 AS DOUBLE), 0) - coalesce(greatest(uhi_delta_c, 0) * 2, 0)
    - coalesce(viirs_radiance * CAST(0.05 AS DOUBLE), 0) - coalesce(CASE WHEN eprtr_facility_min_m > 0 THEN CAST(0.001 AS DOUBLE) / eprtr_facility_min_m END, 0)"""
    return f"""50 + coalesce(greatest(0.0, 25 - train_reach_min) * CAST(1.4 AS DOUBLE), 0) + coalesce(trains_to_bcn_nearest / 30, 0)
    {far('climb_min_m', near, 200.0)} {far('yoga_min_m', near, 250.0)} {far('green_min_m', green, 200.0)} {far('hospital_min_m', hospital, 400.0)}
    + coalesce(CASE WHEN sea_min_m < 3000 THEN 6 END, 0) - coalesce(industry_density_per_km2 * 6, 0) - coalesce(CASE WHEN motorway_within_500m THEN 12 END, 0) + coalesce(ln(1 + pharmacy_density_per_km2), 0){more if wide else ''}"""


@register("score_legacy", f"""WITH {CELLS_SQL} SELECT cell, round(least(100.0, greatest(0.0, {_legacy_sql(5000.0, 4000.0, 8000.0, False)})), 6) AS score,
round(least(100.0, greatest(0.0, {_legacy_sql(10000.0, 4000.0, 10000.0, True)})), 6) AS score_10km FROM cells""")  # fmt: skip
def score_legacy(spark, d):
    frame = cells(spark, d)
    return rounded(frame.select("cell", score.legacy_score(frame).alias("score"), score.legacy_score(frame, catchment=score.CATCHMENT_M).alias("score_10km")))


@register("score_report", f"""WITH {CELLS_SQL}, s AS (SELECT {score_sql('default')} AS s FROM cells) SELECT count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS greatest, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd,
round(median(s), 6) AS median, CAST(count_if(s <= 0) AS BIGINT) AS at_floor, CAST(count_if(s >= 100) AS BIGINT) AS at_cap FROM s""")  # fmt: skip
def score_report(spark, d):
    return rounded(score.report(score.with_score(cells(spark, d))))


@register("normalise_field", f"""WITH {CELLS_SQL}, m AS (SELECT min(climb_min_m) AS lo, max(climb_min_m) AS hi, min(uhi_delta_c) AS ul, max(uhi_delta_c) AS uh FROM cells)
SELECT cell, round(CASE WHEN climb_min_m IS NOT NULL THEN 1 - least(1.0, greatest(0.0, (ln(1 + greatest(climb_min_m, 0)) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)))) END, 6) AS near,
round(least(1.0, greatest(0.0, 0.5 + uhi_delta_c / (2 * greatest(abs(uh), abs(ul))))), 6) AS heat, CAST(motorway_within_500m AS DOUBLE) AS road FROM cells, m""")  # fmt: skip
def normalise_field(spark, d):
    frame = cells(spark, d)
    ends = frame.agg(F.min("climb_min_m").alias("lo"), F.max("climb_min_m").alias("hi"), F.min("uhi_delta_c").alias("ul"), F.max("uhi_delta_c").alias("uh"))
    both = frame.join(F.broadcast(ends))  # one row
    near = display.normalise(F.col("climb_min_m"), F.col("lo"), F.col("hi"), kind="log", good_low=True)
    heat = display.normalise(F.col("uhi_delta_c"), F.col("ul"), F.col("uh"), kind="diverging")
    return rounded(both.select("cell", near.alias("near"), heat.alias("heat"), display.normalise(F.col("motorway_within_500m"), F.lit(0.0), F.lit(1.0), kind="flag").alias("road")))


@register("arc_width", cube_sql(""", p AS (SELECT origin, dest, sum(trips) AS t FROM cube WHERE origin <> dest GROUP BY ALL), m AS (SELECT log10(min(t) + 1) AS lo, log10(max(t) + 1) AS hi FROM p)
SELECT origin, dest, round(1.5 + 6.5 * least(1.0, greatest(0.0, (log10(t + 1) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END)), 6) AS width FROM p, m"""))  # fmt: skip
def arc_width(spark, d):
    pairs = flows.between_zones(od_cube(spark, d)).groupBy("origin", "dest").agg(F.sum("trips").alias("t"))
    ends = pairs.agg(F.log10(F.min("t") + 1).alias("lo"), F.log10(F.max("t") + 1).alias("hi"))
    return rounded(pairs.join(F.broadcast(ends)).select("origin", "dest", display.arc_width(F.col("t"), F.col("lo"), F.col("hi")).alias("width")))


@register("json_payload")
def json_payload(spark, d):
    frame = cells(spark, d).select("cell", "balance", "train_reach_min", "natura2000_within_5km")
    return frame.select("cell", display.safe_json(frame, {"balance": 1, "train_reach_min": 0}).alias("json"))


@register("score_colours")
def score_colours(spark, d):
    frame = score.with_score(cells(spark, d))
    return frame.select("cell", display.score_colour(F.col("liveability_score")).alias("rgb"))


@register("merge_update", f"""WITH {CELLS_SQL}, n AS (SELECT cell, balance * 2 AS balance, k % 3 AS extra FROM cells WHERE k % 2 = 0)
SELECT c.cell, c.label, round(n.balance, 6) AS balance, n.extra FROM cells c LEFT JOIN n ON n.cell = c.cell""")  # fmt: skip
def merge_update(spark, d):
    old = cells(spark, d).select("cell", "label", "balance")
    new = cells(spark, d).where("k % 2 = 0").select("cell", (F.col("balance") * 2).alias("balance"), (F.col("k") % 3).alias("extra"))
    return rounded(combine.merge_update(old, new))


@register("season_value", f"""WITH s AS ({SEASONAL_HOTSPOTS}) SELECT c.cell, s.weekend_ratio AS value FROM (SELECT lower(lpad(upper(to_hex(c_custkey)), 15, '0')) AS cell FROM customer) c LEFT JOIN s ON s.cell = c.cell AND s.season = 'may'""")
def season_value(spark, d):
    return rounded(combine.season_value(cells(spark, d), _seasonal(spark, d), "weekend_ratio", "may"))


@register("reach_requests", """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, 40.5 + (s_suppkey * 37 % 2400) / 1000.0::DOUBLE AS lat, 0.15 + (s_suppkey * 91 % 3200) / 1000.0::DOUBLE AS lon FROM supplier), m AS (SELECT unnest([15, 25]) AS minutes)
SELECT station_id, CAST(minutes AS INTEGER) AS minutes, substr(sha1(printf('%s|%.6f|%.6f|%d', station_id, lat, lon, minutes)), 1, 12) AS cache_key FROM s, m""")  # fmt: skip
def reach_requests(spark, d):
    k = F.col("s_suppkey")
    stations = read(spark, d, "supplier").select(k.cast("string").alias("station_id"), (40.5 + (k * 37 % 2400) / 1000.0).alias("lat"), (0.15 + (k * 91 % 3200) / 1000.0).alias("lon"))
    return reach.requests(stations).select("station_id", "minutes", "cache_key")


# Timetables, sources, places


STOP_TIMES_SQL = """stop_times AS (SELECT l_orderkey AS trip_id, 's' || CAST(l_suppkey AS VARCHAR) AS stop_id FROM lineitem),
trips AS (SELECT o_orderkey AS trip_id, o_orderpriority AS service_id FROM orders), active AS (SELECT trip_id FROM trips WHERE service_id IN ('1-URGENT', '3-MEDIUM')),
stops AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS stop_id, CASE WHEN s_suppkey % 10 = 0 THEN 'Pl. Catalunya ' || s_name ELSE s_name END AS stop_name FROM supplier)"""


@register("stop_frequency", f"""WITH {STOP_TIMES_SQL}, calls AS (SELECT DISTINCT s.trip_id, s.stop_id FROM stop_times s JOIN active a ON a.trip_id = s.trip_id),
core AS (SELECT DISTINCT trip_id FROM calls WHERE stop_id IN (SELECT stop_id FROM stops WHERE lower(stop_name) LIKE '%catalunya%'))
SELECT t.stop_id, count(c.trip_id) AS trips_per_day, count(k.trip_id) AS trips_to_bcn_core FROM stops t LEFT JOIN calls c ON c.stop_id = t.stop_id LEFT JOIN core k ON k.trip_id = c.trip_id GROUP BY t.stop_id""")  # fmt: skip
def stop_frequency(spark, d):
    stop = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    times = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), stop.alias("stop_id"))
    trips = read(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("service_id"))
    name = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("Pl. Catalunya "), "s_name")).otherwise(F.col("s_name"))
    stops = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("stop_id"), name.alias("stop_name"))
    return transit.frequency(stops, trips, times, trips.where(F.col("service_id").isin("1-URGENT", "3-MEDIUM")).select("service_id").distinct())


@register("active_services", """WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS service_id, strftime(o_orderdate, '%Y%m%d') AS date FROM orders), n AS (SELECT date, count(*) AS n FROM a GROUP BY date),
b AS (SELECT date FROM n WHERE isodow(strptime(date, '%Y%m%d')) = 3 ORDER BY n DESC, date LIMIT 1) SELECT DISTINCT service_id FROM a JOIN b USING (date)""")  # fmt: skip
def active_services(spark, d):
    dates = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.lit(1).alias("exception_type"))
    return transit.active_services(None, dates.distinct(), 2)


@register("active_services_other_day", """WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS service_id, strftime(o_orderdate, '%Y%m%d') AS date FROM orders WHERE isodow(o_orderdate) <> 3), n AS (SELECT date, count(*) AS n FROM a GROUP BY date),
b AS (SELECT date FROM n ORDER BY n DESC, date LIMIT 1) SELECT DISTINCT service_id FROM a JOIN b USING (date)""")  # fmt: skip
def active_services_other_day(spark, d):
    """No date is a Wednesday: the date with most services stands in."""
    dates = read(spark, d, "orders").where(F.weekday("o_orderdate") != 2).select(F.col("o_custkey").cast("string").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.lit(1).alias("exception_type"))
    return transit.active_services(None, dates.distinct(), 2)


@register("unpivot_station_mean", """WITH w AS (SELECT l_suppkey AS station, l_returnflag AS pollutant, l_quantity AS h01, l_discount AS h02, l_tax AS h03 FROM lineitem),
u AS (SELECT station, pollutant, h01 AS v FROM w UNION ALL SELECT station, pollutant, h02 FROM w UNION ALL SELECT station, pollutant, h03 FROM w)
SELECT station, pollutant, round(avg(v), 6) AS mean FROM u GROUP BY ALL""")  # fmt: skip
def unpivot_station_mean(spark, d):
    from flowgrid.sources.readers import hourly_to_long

    wide = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.col("l_returnflag").alias("pollutant"), F.col("l_quantity").alias("h01"), F.col("l_discount").alias("h02"), F.col("l_tax").alias("h03"))
    return rounded(hourly_to_long(wide, ["station", "pollutant"]).groupBy("station", "pollutant").agg(F.avg("value").alias("mean")))


@register("poi_categorise", """SELECT p_partkey AS osm_id, CASE WHEN p_type IN ('MEDIUM') OR p_size % 10 = 0 THEN 'climbing' WHEN p_size % 10 = 1 THEN 'yoga' WHEN p_type = 'LARGE' THEN 'park' WHEN p_type = 'PROMO' THEN 'hospital' WHEN p_size % 10 = 2 THEN 'industry' END AS category
FROM part WHERE p_type IN ('MEDIUM', 'LARGE', 'PROMO') OR p_size % 10 <= 2""")  # fmt: skip
def poi_categorise(spark, d):
    sport = F.when(F.col("p_size") % 10 == 0, "climbing").when(F.col("p_size") % 10 == 1, "yoga").otherwise("none")
    kind = F.when(F.col("p_type") == "MEDIUM", "climbing").when(F.col("p_type") == "LARGE", "garden").otherwise("none")
    amenity = F.when(F.col("p_type") == "PROMO", "hospital").otherwise("bakery")
    use = F.when(F.col("p_size") % 10 == 2, "industrial").otherwise("none")
    tags = F.create_map(F.lit("sport"), sport, F.lit("leisure"), kind, F.lit("amenity"), amenity, F.lit("landuse"), use)
    return places.categorise(read(spark, d, "part").select(F.col("p_partkey").alias("osm_id"), tags.alias("tags"))).select("osm_id", "category")


# Geometry


def points(spark, d, table: str, key: str, value: str | None = None):
    """Points at places made from keys, in metres within a square of 300 km."""
    k = F.col(key)
    cols = [k.alias("id"), ((k * 7919) % 300000).cast("double").alias("x"), ((k * 104729) % 300000).cast("double").alias("y")]
    return read(spark, d, table).select(*cols, *([F.col(value).alias("value")] if value else []))


def points_sql(name: str, table: str, key: str, value: str = "") -> str:
    return f"{name} AS (SELECT {key} AS id, CAST(({key} * 7919) % 300000 AS DOUBLE) AS x, CAST(({key} * 104729) % 300000 AS DOUBLE) AS y{', ' + value + ' AS value' if value else ''} FROM {table})"


NEAR_SQL = f"WITH {points_sql('l', 'customer', 'c_custkey')}, {points_sql('r', 'supplier', 's_suppkey', 's_acctbal')}, p AS (SELECT l.id, r.id AS r_id, value, sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) AS d FROM l, r) "


def _left(spark, d):
    return points(spark, d, "customer", "c_custkey")


def _right(spark, d):
    return points(spark, d, "supplier", "s_suppkey", "s_acctbal")


@register("nearest_capped", NEAR_SQL + "SELECT l.id, round(min(d), 6) AS near_m FROM l LEFT JOIN p ON p.id = l.id AND d <= 15000 GROUP BY l.id")
def nearest_capped(spark, d):
    return rounded(spatial.nearest_capped(_left(spark, d), _right(spark, d), 15_000, "near_m").select("id", "near_m"))


@register("nearest_attribute", NEAR_SQL + """SELECT l.id, q.r_id AS nearest_id, q.value, round(q.d, 6) AS distance FROM l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM p WHERE d <= 15000) q ON q.id = l.id AND q.n = 1""")
def nearest_attribute(spark, d):
    return rounded(spatial.nearest_attribute(_left(spark, d), _right(spark, d), 15_000, "value").select("id", "nearest_id", "value", "distance"))


@register("k_nearest", NEAR_SQL + "SELECT id, r_id, round(d, 6) AS distance, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS n FROM p WHERE d <= 30000) WHERE n <= 3")
def k_nearest(spark, d):
    return rounded(spatial.k_nearest(_left(spark, d), _right(spark, d), 30_000, 3))


@register("within_bands", NEAR_SQL + ", m AS (SELECT l.id, min(d) AS d FROM l LEFT JOIN p ON p.id = l.id GROUP BY l.id) SELECT id, CAST(CASE WHEN d <= 5000 THEN 15 WHEN d <= 15000 THEN 25 END AS DOUBLE) AS reach FROM m")
def within_bands(spark, d):
    return spatial.within_bands(_left(spark, d), _right(spark, d), [(5_000, 15), (15_000, 25)], "reach").select("id", "reach")


@register("density_1km", NEAR_SQL + "SELECT l.id, count(p.r_id) AS n, round(count(p.r_id) / 0.735, 6) AS per_km2 FROM l LEFT JOIN p ON p.id = l.id AND d <= 12000 GROUP BY l.id")
def density_1km(spark, d):
    counts = spatial.count_within(_left(spark, d), _right(spark, d), 12_000).select("id", "n")
    return rounded(counts.withColumn("per_km2", F.col("n") / 0.735))


_UTM = {"lon": "0.15 + ((c_custkey * 7919) % 3200) / 1000.0", "lat": "40.5 + ((c_custkey * 104729) % 2400) / 1000.0"}
_SERIES = lambda cs, f, g: " + ".join(f"CAST({c!r} AS DOUBLE) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(cs, 1))


@register("utm_project", f"""WITH p AS (SELECT c_custkey AS id, CAST({_UTM['lon']} AS DOUBLE) AS lon, CAST({_UTM['lat']} AS DOUBLE) AS lat FROM customer),
a AS (SELECT *, sinh(atanh(sin(radians(lat))) - CAST({geo.ECC!r} AS DOUBLE) * atanh(CAST({geo.ECC!r} AS DOUBLE) * sin(radians(lat)))) AS t, radians(lon - 3) AS lam FROM p),
b AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT id, round(500000 + CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) * (eta + {_SERIES(geo.ALPHA, 'cos', 'sinh')}), 3) AS x, round(CAST({geo.K0 * geo.RADIUS!r} AS DOUBLE) * (xi + {_SERIES(geo.ALPHA, 'sin', 'cosh')}), 3) AS y FROM b""")  # fmt: skip
def utm_project(spark, d):
    at = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in _UTM.items()])
    x, y = geo.utm(F.col("lon"), F.col("lat"))
    return rounded(at.select("id", x.alias("x"), y.alias("y")), 3)


@register("cell_counts", f"""WITH {points_sql('l', 'customer', 'c_custkey')}, h AS (SELECT (x * sqrt(3.0) / 3 - y / 3) / CAST({geo.SIDE!r} AS DOUBLE) AS q, y * 2 / 3 / CAST({geo.SIDE!r} AS DOUBLE) AS r FROM l),
c AS (SELECT q, r, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h), e AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM c),
a AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM e)
SELECT lower('8' || lpad(to_hex(q + 134217728), 7, '0') || lpad(to_hex(r + 134217728), 7, '0')) AS cell, count(*) AS n, round(count(*) / 0.737327, 6) AS per_km2 FROM a GROUP BY q, r""")  # fmt: skip
def cell_counts(spark, d):
    return rounded(spatial.cell_counts(_left(spark, d)))


def rectangles(spark, d):
    """A rectangle for each nation, on a grid."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5 * 60000 + 1000).cast("double"), (F.floor(k / 5) * 60000 + 1000).cast("double")
    x1, y1 = x0 + 40000 + 500 * k, y0 + 30000 + 700 * k
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    return read(spark, d, "nation").select(F.lpad(k.cast("string"), 3, "0").alias("zone"), F.array(ring).alias("polygon"))


RECT_SQL = "b AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS zone, n_nationkey % 5 * 60000 + 1000.0 AS x0, n_nationkey // 5 * 60000 + 1000.0 AS y0, n_nationkey % 5 * 60000 + 41000.0 + 500 * n_nationkey AS x1, n_nationkey // 5 * 60000 + 31000.0 + 700 * n_nationkey AS y1 FROM nation)"


@register("point_in_polygon", f"WITH {points_sql('l', 'customer', 'c_custkey')}, {RECT_SQL} SELECT l.id, min(zone) AS zone FROM l LEFT JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY l.id")
def point_in_polygon(spark, d):
    return spatial.point_in_polygon(_left(spark, d), rectangles(spark, d)).select("id", "zone")


@register("nearest_polygon", f"""WITH {points_sql('l', 'customer', 'c_custkey')}, {RECT_SQL}, p AS (SELECT id, sqrt(greatest(x0 - x, x - x1, 0) * greatest(x0 - x, x - x1, 0) + greatest(y0 - y, y - y1, 0) * greatest(y0 - y, y - y1, 0)) AS d FROM l, b)
SELECT l.id, round(min(d), 6) + 0.0 AS near_m FROM l LEFT JOIN p ON p.id = l.id AND d <= 5000 GROUP BY l.id""")  # fmt: skip
def nearest_polygon(spark, d):
    return rounded(spatial.nearest_shape(_left(spark, d), rectangles(spark, d), 5_000, "near_m").select("id", "near_m"))


def squares(spark):
    """Squares of 20 km that cover the grid of rectangles."""
    i, j = F.floor(F.col("id") / 20).cast("double") * 20000, (F.col("id") % 20).cast("double") * 20000
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(i, j), point(i + 20000, j), point(i + 20000, j + 20000), point(i, j + 20000))
    return spark.range(400).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("cell"), ring.alias("ring"))


@register("overlay_weights_rect", f"""WITH {RECT_SQL}, g AS (SELECT lpad(CAST(i AS VARCHAR), 3, '0') AS cell, (i // 20) * 20000.0 AS u, (i % 20) * 20000.0 AS v FROM (SELECT unnest(range(400)) AS i)),
o AS (SELECT zone, cell, CAST((least(x1, u + 20000) - greatest(x0, u)) * (least(y1, v + 20000) - greatest(y0, v)) AS DOUBLE) AS a FROM b JOIN g ON x0 < u + 20000 AND u < x1 AND y0 < v + 20000 AND v < y1)
SELECT zone, cell, round(a / sum(a) OVER (PARTITION BY zone), 9) AS weight FROM o""")  # fmt: skip
def overlay_weights_rect(spark, d):
    return rounded(spatial.overlay_weights(rectangles(spark, d), squares(spark)), 9)


@register("overlay_weights_hex")
def overlay_weights_hex(spark, d):
    return spatial.hex_crosswalk(rectangles(spark, d))


@register("hex_grid_cover")
def hex_grid_cover(spark, d):
    return spatial.hex_cover(rectangles(spark, d), full=False).select("zone", "cell", "q", "r")


@register("quadkeys", """WITH p AS (SELECT c_custkey AS id, CAST(0.15 + ((c_custkey * 7919) % 3200) / 1000.0 AS DOUBLE) AS lon, CAST(40.5 + ((c_custkey * 104729) % 2400) / 1000.0 AS DOUBLE) AS lat FROM customer),
t AS (SELECT id, CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256) AS BIGINT) AS y FROM p)
SELECT id, """ + " || ".join(f"CAST(((x >> {i}) & 1) + 2 * ((y >> {i}) & 1) AS VARCHAR)" for i in reversed(range(8))) + " AS quadkey FROM t")  # fmt: skip
def quadkeys(spark, d):
    at = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in _UTM.items()])
    return at.select("id", geo.quadkey(F.col("lon"), F.col("lat"), 8).alias("quadkey"))


# Rasters: pixels made from line items


@register("zonal_mean", f"""WITH l AS (SELECT CAST((l_orderkey * 7919) % 6000 AS DOUBLE) AS x, CAST((l_partkey * 104729) % 6000 AS DOUBLE) AS y, l_quantity AS value FROM lineitem WHERE l_quantity <> 50),
h AS (SELECT (x * sqrt(3.0) / 3 - y / 3) / CAST({geo.SIDE!r} AS DOUBLE) AS q, y * 2 / 3 / CAST({geo.SIDE!r} AS DOUBLE) AS r, value FROM l),
c AS (SELECT q, r, value, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h), e AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM c),
a AS (SELECT value, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM e)
SELECT lower('8' || lpad(to_hex(q + 134217728), 7, '0') || lpad(to_hex(r + 134217728), 7, '0')) AS cell, round(avg(value), 6) AS mean, count(*) AS pixels FROM a GROUP BY q, r""")  # fmt: skip
def zonal_mean(spark, d):
    pixels = read(spark, d, "lineitem").select(((F.col("l_orderkey") * 7919) % 6000).cast("double").alias("x"), ((F.col("l_partkey") * 104729) % 6000).cast("double").alias("y"), F.col("l_quantity").alias("value"))
    return rounded(spatial.zonal_mean(pixels, nodata=(50.0,)))


@register("uhi_delta", f"WITH {CELLS_SQL}, b AS (SELECT quantile_cont(balance, 0.25) AS b FROM cells) SELECT cell, round(balance - b, 6) + 0.0 AS delta FROM cells, b")
def uhi_delta(spark, d):
    return rounded(spatial.baseline_delta(cells(spark, d).select("cell", "balance"), "balance", "delta").select("cell", "delta"))


@register("median_composite", """SELECT CAST(l_suppkey AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, round(median(l_extendedprice * CAST(0.00341802 AS DOUBLE) + 149 - CAST(273.15 AS DOUBLE)), 6) AS celsius FROM lineitem WHERE l_extendedprice <> 0 GROUP BY l_suppkey, l_linenumber""")
def median_composite(spark, d):
    pixels = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_extendedprice").alias("value"))
    return rounded(spatial.composite_median(pixels))


@register("raster_delta", """WITH a AS (SELECT l_suppkey AS s, l_linenumber AS n, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_linenumber AS n, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT CAST(a.s AS DOUBLE) AS x, CAST(a.n AS DOUBLE) AS y, round(a.v - b.v, 4) + 0.0 AS value FROM a JOIN b ON a.s = b.s AND a.n = b.n""")  # fmt: skip
def raster_delta(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), "l_quantity", "l_returnflag")
    layer = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("x", "y").agg(F.sum("l_quantity").alias("value"))
    return rounded(spatial.raster_delta(layer("A"), layer("R")), 4)


@register("convex_hulls")
def convex_hulls(spark, d):
    at = points(spark, d, "customer", "c_custkey").withColumn("g", F.pmod(F.col("id"), F.lit(25)))
    return spatial.convex_hulls(at, "g")


@register("density_clusters")
def density_clusters(spark, d):
    return spatial.cluster_points(points(spark, d, "customer", "c_custkey"), 9_000, 4)


@register("knn_embeddings_by_20", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT q.vec_id AS id, e.vec_id AS r_id, list_distance(q.v, e.v) AS d FROM v q JOIN v e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT id, r_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 4), r_id) AS n FROM p) WHERE n <= 3""")  # fmt: skip
def knn_embeddings_by_20(spark, d):
    """The three nearest vectors of the same label, for every vector whose id is divisible by 20, in blocks against all vectors."""
    return nearest_of_label(read(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 3)


def nearest_of_label(vectors: DataFrame, wanted: Column, k: int, query_rows: int = 512, rows: int = 4096) -> DataFrame:
    """(id, r_id, rank) of the k nearest by distance to 4 decimals, then id; blocks of queries meet blocks of all vectors of their label."""
    from pyspark.sql.window import Window as W

    e = vectors.where("embedding is not null and label is not null and vec_id is not null").select("vec_id", "label", "embedding", wanted.alias("asks"))
    sizes = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("m")).where("m > 0")
    sizes = sizes.select("l", F.ceil(F.col("m") / query_rows).alias("m"), F.ceil(F.col("n") / rows).alias("n"))
    placed = e.join(sizes, F.col("label") == F.col("l"))
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    asking = placed.where("asks").select("label", own("m").alias("q"), every("n").alias("b"), F.lit(True).alias("asks"), "vec_id", "embedding")
    facing = placed.select("label", every("m").alias("q"), own("n").alias("b"), F.lit(False).alias("asks"), "vec_id", "embedding")

    def nearest(block):
        import numpy as np
        import pandas as pd

        q, e = block[block["asks"]], block[~block["asks"]]
        ids, found = e["vec_id"].to_numpy(), []
        v = np.array(e["embedding"].tolist(), np.float64).reshape(len(e), -1)
        for i, x in zip(q["vec_id"], q["embedding"], strict=True):
            other = ids != i
            if not other.any():
                continue
            far = np.sqrt(((v[other] - np.asarray(x, np.float64)) ** 2).sum(1))
            at = far <= np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1] + 1e-3  # and what may be equal to 4 decimals
            found.append(pd.DataFrame({"id": i, "r_id": ids[other][at], "d": far[at]}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "r_id": [], "d": []})

    pairs = asking.unionByName(facing).groupBy("label", "q", "b").applyInPandas(nearest, "id long, r_id long, d double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.round("d", 4), "r_id"))
    return pairs.withColumn("rank", rank).where(f"rank <= {k}").select("id", "r_id", "rank")


@register("event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from flowgrid.streaming.rollup import windowed_totals

    return windowed_totals(read(spark, d, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})
