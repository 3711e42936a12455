"""Registered queries of flowgrid.operators.exports and of the store, and their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowgrid.operators import exports, flows, score
from flowgrid.plans import catalog
from flowgrid.plans.catalog import CELLS_SQL, ORACLES, QUERIES, RECT_SQL, SLICES_SQL, cube_sql, points, points_sql, register, rounded, score_sql, silver
from flowgrid.session import ensure_checkpoint_dir
from flowgrid.sources import readers, sinks
from flowgrid.sources.cube import crosswalk, od_cube, read

__all__ = ["ORACLES", "QUERIES"]


def sliced(spark, d):
    return flows.slices(silver(spark, d), 40)


@register("od_slices_located", cube_sql(SLICES_SQL + "SELECT season, day_type, origin, dest FROM b WHERE CAST(substr(origin, 3) AS INTEGER) % 4 <> 0 AND CAST(substr(dest, 3) AS INTEGER) % 4 <> 0"))
def od_slices_located(spark, d):
    """A quarter of the zones has no place."""
    placed = catalog.centroids(spark, d).where(F.col("zone").substr(3, 3).cast("int") % 4 != 0)
    return exports.located(sliced(spark, d), placed).select("season", "day_type", "origin", "dest")


@register("od_slice_by_key", cube_sql(SLICES_SQL + "SELECT b.origin, b.dest, round(b.t / n, 2) AS trips_day FROM b JOIN n USING (season, day_type) WHERE season = 'may' AND day_type = 'weekend'"))
def od_slice_by_key(spark, d):
    return exports.slice_of(sliced(spark, d), "may", "weekend").select("origin", "dest", "trips_day")


@register("od_flow_ranks", cube_sql(SLICES_SQL + """, v AS (SELECT b.season, b.day_type, b.origin, b.dest, round(b.t / n, 2) AS trips_day FROM b JOIN n USING (season, day_type))
SELECT *, CAST(dense_rank() OVER (PARTITION BY season, day_type ORDER BY trips_day DESC) AS INTEGER) AS flow_rank FROM v"""))  # fmt: skip
def od_flow_ranks(spark, d):
    return exports.flow_ranks(sliced(spark, d).drop("hourly"))


@register("slice_index", cube_sql(SLICES_SQL + """, v AS (SELECT season, day_type, origin, dest, round(t / n, 2) AS f FROM b JOIN n USING (season, day_type)),
z AS (SELECT season, day_type, count(DISTINCT zone) AS locations FROM (SELECT season, day_type, origin AS zone FROM v UNION SELECT season, day_type, dest FROM v) GROUP BY ALL),
e AS (SELECT season, day_type, count(*) AS flows, min(f) AS lo, max(f) AS hi FROM v GROUP BY ALL)
SELECT season, day_type, flows, locations, lo, hi, min(lo) OVER () AS all_lo, max(hi) OVER () AS all_hi FROM e JOIN z USING (season, day_type)"""))  # fmt: skip
def slice_index(spark, d):
    return exports.slice_index(sliced(spark, d))


_LON, _LAT = "0.15 + (k * 7919 % 3200) / 1000.0", "40.5 + (k * 104729 % 2400) / 1000.0"


@register("od_arcs_dominant", cube_sql(f""", w AS (SELECT zone, cell, row_number() OVER (PARTITION BY zone ORDER BY weight DESC, cell) AS r FROM xwalk),
c AS (SELECT zone, CAST({_LON} AS DOUBLE) AS lon, CAST({_LAT} AS DOUBLE) AS lat FROM (SELECT zone, CAST('0x' || cell AS BIGINT) AS k FROM w WHERE r = 1)),
k AS (SELECT * FROM silver WHERE origin <> dest), n AS (SELECT count(DISTINCT day) AS n FROM k),
p AS (SELECT origin, dest, sum(trips) / n AS v FROM k, n GROUP BY origin, dest, n ORDER BY v DESC, origin, dest LIMIT 200)
SELECT origin, dest, round(a.lon, 5) AS o_lon, round(a.lat, 5) AS o_lat, round(b.lon, 5) AS d_lon, round(b.lat, 5) AS d_lat, round(v, 1) AS value FROM p JOIN c a ON a.zone = origin JOIN c b ON b.zone = dest"""))  # fmt: skip
def od_arcs_dominant(spark, d):
    xwalk = crosswalk(spark, d)
    at = lambda e: F.expr(f"CAST({e.replace('k *', 'cast(conv(cell, 16, 10) as bigint) *')} AS DOUBLE)")
    places = exports.cell_places(xwalk, at(_LON), at(_LAT))
    return flows.arcs(flows.corridors(silver(spark, d), 200), exports.dominant_places(xwalk, places))


_ZONE_PARTS = """, i AS (SELECT dest AS zone, sum(trips) AS t, sum(CASE WHEN origin = dest THEN trips ELSE 0 END) AS intra, sum(CASE WHEN band IN ('50-100', '>100') THEN trips ELSE 0 END) AS far,
  sum(CASE WHEN act_d IN ('frecuente', 'no_frecuente') THEN trips ELSE 0 END) AS leisure, sum(CASE WHEN act_d = 'trabajo_estudio' THEN trips ELSE 0 END) AS commute FROM silver GROUP BY dest),
o AS (SELECT origin AS zone, sum(trips) AS t FROM silver GROUP BY origin)
"""


@register("zone_indices", cube_sql(_ZONE_PARTS + """SELECT coalesce(i.zone, o.zone) AS zone, round(intra / i.t, 6) AS intra_share, round(far / i.t, 6) AS long_share, round(leisure / i.t, 6) AS leisure_share,
round(commute / i.t, 6) AS commute_share, round(ln(greatest(coalesce(o.t, 0), 1) / greatest(coalesce(i.t, 0), 1)), 6) + 0.0 AS sink_source FROM i FULL JOIN o ON i.zone = o.zone"""))  # fmt: skip
def zone_indices(spark, d):
    return rounded(exports.zone_indices(silver(spark, d)))


@register("zone_typology")
def zone_typology(spark, d):
    return exports.zone_typology(silver(spark, d), crosswalk(spark, d))


@register("zone_rhythm_profile", cube_sql(""", z AS (SELECT dest AS zone, hour, sum(trips) AS v FROM silver GROUP BY ALL), s AS (SELECT zone, sum(v) AS t FROM z GROUP BY zone),
f AS (SELECT s.zone, CAST(h AS INTEGER) AS hour, coalesce(v, 0) / t AS share FROM s CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN z ON z.zone = s.zone AND z.hour = h)
SELECT cell, hour, round(sum(share * weight) / sum(weight), 6) AS share FROM xwalk JOIN f ON f.zone = xwalk.zone GROUP BY ALL"""))  # fmt: skip
def zone_rhythm_profile(spark, d):
    hours = [f"h{h}" for h in range(24)]
    cells = flows.spread_average(exports.zone_profile(silver(spark, d)), crosswalk(spark, d), hours)
    return rounded(cells.select("cell", F.posexplode(F.array(*hours)).alias("hour", "share")))


@register("typology_centers")
def typology_centers(spark, d):
    indices = flows.typology_indices(silver(spark, d), crosswalk(spark, d))
    return rounded(exports.cluster_centers(indices.join(flows.typology(indices), "cell"), "label"))


@register("label_centers", f"""WITH {CELLS_SQL} SELECT label, count(*) AS n, round(avg(balance), 6) AS balance, round(avg(climb_min_m), 6) AS climb_min_m, round(avg(uhi_delta_c), 6) AS uhi_delta_c FROM cells GROUP BY label""")
def label_centers(spark, d):
    return rounded(exports.cluster_centers(catalog.cells(spark, d), "label", ("balance", "climb_min_m", "uhi_delta_c")))


@register("grid_restrict", f"WITH {CELLS_SQL}, g AS (SELECT DISTINCT lower(lpad(upper(to_hex(o_custkey)), 15, '0')) AS cell FROM orders WHERE o_orderstatus = 'F') SELECT cell, balance FROM cells WHERE cell IN (SELECT cell FROM g)")
def grid_restrict(spark, d):
    """The grid: cells of customers with a finished order."""
    grid = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lower(F.lpad(F.hex("o_custkey"), 15, "0")).alias("cell"))
    return exports.on_grid(catalog.cells(spark, d).select("cell", "balance"), grid)


@register("hospital_union", "SELECT CAST(s_nationkey AS DOUBLE) / 10 AS lon, 41 + CAST(s_suppkey % 7 AS DOUBLE) / 10 AS lat FROM supplier UNION SELECT CAST(c_nationkey AS DOUBLE) / 10, 41 + CAST(c_custkey % 7 AS DOUBLE) / 10 FROM customer")
def hospital_union(spark, d):
    """Two sources of places that share some of their points."""
    at = lambda t, nation, key: read(spark, d, t).select((F.col(nation).cast("double") / 10).alias("lon"), (41 + (F.col(key) % 7).cast("double") / 10).alias("lat"))
    return exports.one_place_each(at("supplier", "s_nationkey", "s_suppkey"), at("customer", "c_nationkey", "c_custkey"))


@register("facilities_once", """SELECT facility_id, lon, lat, name FROM (SELECT o_custkey AS facility_id, CAST(o_orderkey % 97 AS DOUBLE) AS lon, CAST(o_orderkey % 89 AS DOUBLE) AS lat, o_orderpriority AS name,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 97, o_orderkey % 89, o_orderpriority) AS r FROM orders) WHERE r = 1""")  # fmt: skip
def facilities_once(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("facility_id"), (k % 97).cast("double").alias("lon"), (k % 89).cast("double").alias("lat"), F.col("o_orderpriority").alias("name"))
    return exports.one_row_each(rows, "facility_id", ["lon", "lat"])


@register("near_protected", f"""WITH {points_sql('l', 'customer', 'c_custkey')}, {RECT_SQL}, g AS (SELECT (i // 20) * 20000.0 AS u, (i % 20) * 20000.0 AS v FROM (SELECT unnest(range(400)) AS i) WHERE i % 9 = 0),
t AS (SELECT DISTINCT b.* FROM b JOIN g ON x0 < u + 20000 AND u < x1 AND y0 < v + 20000 AND v < y1),
p AS (SELECT id, min(sqrt(greatest(x0 - x, x - x1, 0) * greatest(x0 - x, x - x1, 0) + greatest(y0 - y, y - y1, 0) * greatest(y0 - y, y - y1, 0))) AS d FROM l, t GROUP BY id)
SELECT id, coalesce(d <= 5000, false) AS natura2000_within_5km FROM l LEFT JOIN p USING (id)""")  # fmt: skip
def near_protected(spark, d):
    """Every ninth square is land; areas without land don't count."""
    land = catalog.squares(spark).where(F.col("cell").cast("int") % 9 == 0)
    return exports.near_protected(points(spark, d, "customer", "c_custkey"), catalog.rectangles(spark, d), land).select("id", "natura2000_within_5km")


@register("story_cells", f"WITH {CELLS_SQL} SELECT cell, {', '.join(f'round({score_sql(p)}, 1) AS score_{p}' for p in score.PRESETS)} FROM cells")
def story_cells(spark, d):
    return exports.story_cells(catalog.cells(spark, d))


_QUANTILES = ", ".join(f"round(quantile_cont(s, {q}), 2) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75))


@register("story_statistics", f"""WITH {CELLS_SQL}, s AS ({' UNION ALL '.join(f"SELECT '{p}' AS preset, {score_sql(p)} AS s FROM cells" for p in score.PRESETS)})
SELECT preset, round(min(s), 2) AS min, {_QUANTILES}, round(max(s), 2) AS max, round(avg(s), 2) AS mean, round(stddev_samp(s), 2) AS std FROM s GROUP BY preset""")  # fmt: skip
def story_statistics(spark, d):
    return exports.story_statistics(catalog.cells(spark, d))


# Files


def raw_rows(spark, d):
    """The cube under the raw columns' names, all strings but the two measures."""
    names = {v: k for k, v in readers.NAMES.items()}
    cube = od_cube(spark, d).withColumnsRenamed(names)
    return cube.select(*[F.col(c).cast("double" if c.startswith("viajes") else "string").alias(c) if c in cube.columns else F.lit(None).cast("string").alias(c) for c in readers.RAW_COLUMNS])


@register("store_scan", cube_sql("""SELECT origin, dest, count(*) AS n, round(sum(trips), 4) AS trips FROM cube
WHERE day BETWEEN '19960115' AND '19960320' AND (substr(origin, 1, 2) = '00' OR substr(dest, 1, 2) = '00') GROUP BY ALL"""))  # fmt: skip
def store_scan(spark, d):
    """From delimited files to the partitioned store, and back by day and prefix; the files lie in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    raw_rows(spark, d).where(F.col("fecha").between("19960101", "19960401")).write.option("sep", "|").option("header", True).csv(f"{root}/text")
    sinks.ingest(spark, f"{root}/text", f"{root}/bronze", zoning="distritos", kind="hourly", prefixes=None)
    kept = readers.bronze(spark, f"{root}/bronze", zoning="distritos", kind="hourly", first="19960115", last="19960320", prefixes=["00"])
    return rounded(kept.groupBy(F.col("origen").alias("origin"), F.col("destino").alias("dest")).agg(F.count("*").alias("n"), F.sum("viajes").alias("trips")), 4)


# SQL of queries declared elsewhere

ORACLES["score_colours"] = (lambda stops: f"""WITH {CELLS_SQL}, s AS (SELECT cell, {score_sql('default')} / 100 * 4 AS p FROM cells), b AS (SELECT cell, p, CAST(least(floor(p), 3) AS INTEGER) AS k FROM s)
SELECT cell, [{', '.join(f"CAST(floor({c}[k + 1] + ({c}[k + 2] - {c}[k + 1]) * (p - k)) AS INTEGER)" for c in stops)}] AS rgb FROM b""")([str([s[i] for s in catalog.display.STOPS]) for i in range(3)])  # fmt: skip

#: Clusters by closure over core links.
ORACLES["density_clusters"] = f"""WITH RECURSIVE {points_sql('l', 'customer', 'c_custkey')},
near AS (SELECT a.id, b.id AS r_id FROM l a, l b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9000.0 * 9000.0),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 4),
link AS (SELECT id, r_id FROM near WHERE id IN (SELECT id FROM core) AND r_id IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT link.r_id, reach.root FROM reach JOIN link ON link.id = reach.id),
label AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
edge AS (SELECT near.id, min(label) AS label FROM near JOIN label ON label.id = near.r_id GROUP BY near.id)
SELECT l.id, coalesce(label.label, edge.label) AS cluster FROM l LEFT JOIN label ON label.id = l.id LEFT JOIN edge ON edge.id = l.id"""
