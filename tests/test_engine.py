"""The mobility engine on hand-made data and against DuckDB."""

import datetime
import json
import math
import random
import threading
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from flowgrid import contracts
from flowgrid.functions import display, geo
from flowgrid.operators import flows, places, score, spatial, stats, transit
from flowgrid.plans import catalog
from flowgrid.sources import readers, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OD = "day string, hour int, origin string, dest string, band string, act_o string, act_d string, income string, age string, sex string, trips double, trip_km double"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(values):
    out = []
    for v in values:
        if v is None or isinstance(v, float) and math.isnan(v):
            out.append("")
        elif isinstance(v, float):
            out.append(f"{v:.6g}")
        elif isinstance(v, datetime.datetime | datetime.date):
            out.append(str(v)[:10])
        else:
            out.append(str(v))
    return tuple(out)


@pytest.mark.parametrize("name", ["inflow_outflow", "weekend_hotspots_seasonal", "geodemographic", "od_slices_topn", "score_default", "score_sensitivity", "nearest_attribute", "overlay_weights_rect", "contract_report", "stop_frequency",
    "daily_rollup", "inflow_outflow_mean", "centroid_totals", "hourly_rhythm", "hourly_rhythm_wide", "weekend_hotspots_gated", "typology_indices", "score_legacy", "active_services", "active_services_other_day",
    "season_preflight", "od_slices_located", "od_flow_ranks", "slice_index", "od_arcs_dominant", "zone_indices", "near_protected", "facilities_once", "story_statistics", "store_scan", "score_colours"])
def test_against_sql(spark, duck, name):
    from flowgrid.plans import exports

    frame = exports.QUERIES[name](spark, SF)
    got = sorted(plain(r[c] for c in sorted(frame.columns)) for r in frame.collect())
    sql = duck.sql(exports.ORACLES[name])
    order = sorted(range(len(sql.columns)), key=lambda i: sql.columns[i])
    assert sorted(frame.columns) == sorted(sql.columns)
    assert got == sorted(plain(r[i] for i in order) for r in sql.fetchall()) and got


@pytest.mark.parametrize("name, keys", [("score_colours", [388500, 566250]), ("story_cells", [4500, 4650, 5550])])
def test_scores_at_a_step(spark, tmp_path, name, keys):
    """Cells whose colour or rounded score lies at a step, where the last bit decides."""
    from flowgrid.plans import exports

    con = duckdb.connect()
    con.sql(f"create table customer as select unnest({keys})::bigint as c_custkey, 'BUILDING' as c_mktsegment, 1.0::double as c_acctbal")
    con.sql(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    got = exports.QUERIES[name](spark, str(tmp_path))
    want = con.sql(exports.ORACLES[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_cube_is_scanned_once(spark):
    """Flows in and out, rhythm, weekends and typology read the line items once."""
    for name in ("inflow_outflow", "inflow_outflow_mean", "centroid_totals", "hourly_rhythm", "weekend_hotspots_gated", "typology_indices", "daily_rollup"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1, name


def test_slices_by_key_and_plans():
    from datetime import date

    from flowgrid.operators import exports

    with pytest.raises(KeyError):
        exports.slice_of(None, "august", "weekend")
    base = "https://movilidad-opendata.mitma.es/estudios_basicos/por-distritos/viajes/"
    url = lambda kind: readers.plan_files(kind, [date(2024, 10, 15)])[0].url
    assert url("daily") == base + "ficheros-diarios/2024-10/20241015_Viajes_distritos.csv.gz"
    assert url("hourly") == base + "2024-10/20241015_Viajes_distritos.csv.gz"


def test_every_query_is_declared(spark):
    import __spark_entry__

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_outside_imports_llm():
    from pathlib import Path

    import flowgrid

    root = Path(flowgrid.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "flowgrid.llm" in p.read_text()]


@pytest.fixture(scope="module")
def od(spark):
    rows = [
        ("20250203", 8, "08001", "08002", "2-10", "casa", "trabajo_estudio", "<10", "0-25", "mujer", 10.0, 50.0),
        ("20250203", 18, "08002", "08001", "2-10", "trabajo_estudio", "casa", None, None, None, 4.0, 20.0),
        ("20250208", 12, "08001", "08002", ">100", "casa", "frecuente", "10-15", "65-100", "hombre", 6.0, 700.0),
        ("20250601", 12, "17001", "08002", "10-50", "casa", "no_frecuente", ">15", "25-45", "mujer", 8.0, 90.0),
        ("20250604", 23, "08002", "08002", "0.5-2", "casa", "casa", "<10", "0-25", "hombre", 2.0, 1.0),
        ("20250604", 7, "28001", "28002", "0.5-2", "casa", "casa", "<10", "0-25", "hombre", 2.0, 1.0),
    ]
    return spark.createDataFrame(rows, OD)


@pytest.fixture(scope="module")
def xwalk(spark):
    return spark.createDataFrame([("08001", "a", 1.0), ("08002", "a", 0.25), ("08002", "b", 0.75), ("17001", "c", 1.0), ("28001", "d", 1.0), ("28002", "d", 1.0)], "zone string, cell string, weight double")


def test_flows_by_hand(od, xwalk):
    s = flows.silver(od)
    assert {r.day: (r.weekday, r.is_weekend, r.season) for r in s.collect()} == {"20250203": (2, False, "feb"), "20250208": (7, True, "feb"), "20250601": (1, True, "jun"), "20250604": (4, False, "jun")}
    assert s.where("income = 'NA' and age = 'NA' and sex = 'NA'").count() == 1
    cells = {r.cell: r for r in flows.inflow_outflow(s, xwalk).collect()}
    assert cells["b"].inflow == pytest.approx(26 * 0.75 / 4) and cells["b"].outflow == pytest.approx(6 * 0.75 / 4)
    assert cells["c"].through is None and cells["a"].inflow == pytest.approx((4 + 26 * 0.25) / 4)
    total = sum(r.inflow for r in cells.values())
    assert total * 4 == pytest.approx(32)
    shares = flows.hour_shares(s, xwalk)
    assert all(abs(r.t - 1) < 1e-12 for r in shares.groupBy("cell").agg(F.sum("share").alias("t")).collect())
    peak = {r.cell: (r.peak_hour, r.peak_part) for r in flows.rhythm(shares).collect()}
    assert peak["b"] == (12, "midday")  # 14 trips at noon
    hot = {r.cell: r for r in flows.weekend_hotspots(s, xwalk, min_support=2).collect()}
    assert hot["b"].weekend_ratio == pytest.approx(7 / 6) and hot["b"].leisure_share == pytest.approx(14 / 26) and hot["b"].hotspot_score == pytest.approx(7 / 6 * (0.5 + 14 / 26))
    assert flows.weekend_hotspots(s, xwalk, min_support=100).where("hotspot_score is not null").count() == 0
    geo_ = {r.cell: r for r in flows.geodemographic(s, xwalk).collect()}
    assert geo_["b"].female_share == pytest.approx(18 / 26) and geo_["a"].sex_coverage == pytest.approx(6.5 / 10.5)
    bits = {r.cell: r.diversity for r in flows.entropy_bits(s, xwalk).collect()}
    p = [12 / 26, 6 / 26, 8 / 26]
    assert bits["b"] == pytest.approx(-sum(x * math.log2(x) for x in p))
    top = flows.corridors(s, 2).collect()
    assert [(r.origin, r.dest, r.trips_day) for r in top] == [("08001", "08002", 4.0), ("17001", "08002", 2.0)]
    assert [r.trips_day for r in flows.corridors(s, 5, weekend=True).collect()] == [4.0, 3.0]


def test_cluster_names():
    features = ["intra_share", "leisure_share", "commute_share", "long_share"]
    centers = [[2.0, 0.1, 0.0, 0.0], [1.5, 1.0, 0.0, 0.0], [0.1, 0.2, 0.3, 0.1], [-3.0, 0.0, 0.0, 0.6]]
    assert flows.name_clusters(centers, features) == ["self-contained", "leisure-magnet", "mixed-balanced", "transit-corridor"]


def test_stats_by_hand(spark, od):
    totals = stats.weekday_totals(od).orderBy("n").collect()
    assert [r.mean_trips for r in totals] == [14.0, None, 4.0, None, None, 6.0, 8.0]
    assert stats.hourly_profile(od).where("weekday_name = 'tue'").first().h8 == 0.0
    days = spark.createDataFrame([(f"202501{d:02d}", 10.0 + d % 3) for d in range(1, 29)] + [("20250129", 500.0)], "day string, trips double")
    assert [r.day for r in stats.anomalies(days).collect()] == ["20250129"]
    counts = stats.label_counts(spark.createDataFrame([("b",), ("z",), ("b",), (None,)], "l string"), "l", ["a", "b"]).collect()
    assert [(r.label, r.n) for r in counts] == [("a", 0), ("b", 2), ("z", 1)]


# Contracts


def test_contracts(spark):
    assert len(contracts.REGISTRY) == 13 and set(contracts.OD_DAILY.fields) < set(contracts.OD_HOURLY.fields)
    good = [("20241015", "08019_AC02", "0801", "2-10", "casa", "casa", "1.5", "2.0", None, "extra")]
    columns = "fecha string, origen string, destino string, distancia string, actividad_origen string, actividad_destino string, viajes string, viajes_km string, renta string, other string"
    frame = contracts.OD_DAILY.validate(spark.createDataFrame(good, columns))
    assert "other" not in frame.columns and dict(frame.dtypes)["viajes"] == "double" and frame.first().origen == "08019_AC02"
    bad = [("2024", "08", "0801", ">50", "casa", None, "-1", "x", "much", "e")]
    with pytest.raises(contracts.ContractError) as e:
        contracts.OD_DAILY.validate(spark.createDataFrame(bad, columns))
    assert {(c, r) for c, r, _ in e.value.failures} == {("fecha", "pattern"), ("origen", "length"), ("distancia", "domain"), ("actividad_destino", "null"), ("viajes", "range"), ("viajes_km", "type"), ("renta", "domain")}
    with pytest.raises(contracts.ContractError):
        contracts.STOPS.validate(spark.createDataFrame([("s", "n", 2.0, 41.0, "fgc")] * 2, "stop_id string, stop_name string, lon double, lat double, feed string"))


# Sources and sinks


def test_cube_files(spark, tmp_path):
    header = "|".join(readers.RAW_COLUMNS)
    line = lambda day, o, d: f"{day}|08|{o}|{d}|2-10|casa|casa|no|no|08|<10|NA|NA|2.5|9.0"
    raw = tmp_path / "day.csv"
    raw.write_text("\n".join([header, line("20250201", "28001", "28002"), line("20250201", "28001", "08002"), line("20250202", "08001", "08001")]) + "\n")
    frame = readers.raw_cube(spark, str(raw))
    assert frame.count() == 2 and frame.first().periodo == 8
    with pytest.raises(ValueError):
        readers.raw_cube(spark, str(raw), kind="weekly")
    root = str(tmp_path / "bronze")
    sinks.ingest(spark, str(raw), root, zoning="districts", kind="hourly", prefixes=None)
    back = readers.bronze(spark, root, zoning="districts", kind="hourly", first="20250202", last="20250202", prefixes=["08"])
    assert [(r.fecha, r.origen) for r in back.collect()] == [("20250202", "08001")]
    assert readers.bronze(spark, root, zoning="districts", kind="hourly").count() == 3
    assert tuple(readers.stored_days(readers.bronze(spark, root, zoning="districts", kind="hourly")).first()) == ("20250201", "20250202", 2)
    assert "origin" in readers.as_cube(back).columns
    assert readers.first_existing(spark, [str(tmp_path / "no"), root]) == root


def test_geojson_wkt_and_shapes(spark, tmp_path):
    ring = [[2.0, 41.0], [2.1, 41.0], [2.1, 41.1], [2.0, 41.1], [2.0, 41.0]]
    hole = [[2.04, 41.04], [2.06, 41.04], [2.06, 41.06], [2.04, 41.06], [2.04, 41.04]]
    body = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ID": "08001", "name": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring, hole]}},
        {"type": "Feature", "properties": {"ID": "08002"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [hole]]}},
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(body))
    zones = readers.zones_geojson(spark, str(tmp_path / "z.geojson"))
    areas = sorted((r.zone, round(r.a, 6)) for r in zones.select("zone", geo.area(F.col("polygon")).alias("a")).collect())
    assert areas == [("08001", 0.0096), ("08002", 0.0004), ("08002", 0.01)]
    inside = zones.where("zone = '08001'").select(geo.contains(F.col("polygon"), F.lit(2.02), F.lit(41.02)).alias("a"), geo.contains(F.col("polygon"), F.lit(2.05), F.lit(41.05)).alias("b")).first()
    assert inside.a and not inside.b
    wkt = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 1), ("LINESTRING (0 0, 3 4)", 2), ("none", 3)], "w string, k int").withColumn("p", geo.parse_wkt(F.col("w")))
    assert wkt.where("k = 1").select(geo.area(F.col("p")).alias("a")).first().a == 100
    assert wkt.where("k = 2").select(geo.line_distance(F.get("p", F.lit(0)), F.lit(3.0), F.lit(0.0)).alias("d")).first().d == pytest.approx(2.4)
    assert wkt.where("k = 3").first().p is None


def test_timetables(spark, tmp_path):
    files = {
        "stops": "stop_id , stop_name,stop_lat,stop_lon\ns1,Barcelona-Sants,41.38,2.14\ns2,Elsewhere,41.5,2.2\ns3,Far,40.0,-3.0\ns4,Bad,x,2\n",
        "trips": "trip_id,service_id\nt1,w\nt2,w\nt3,h\n", "stop_times": "trip_id,stop_id\nt1,s1\nt1,s2\nt2,s2\nt2,s2\nt3,s2\n",
        "calendar_dates": "service_id,date,exception_type\nw,20250203,1\nh,20250203,1\nw,20250210,1\nv,20250204,1\n",
    }
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name, text in files.items():
            z.writestr(f"{name}.txt", text)
            (tmp_path / f"{name}.txt").write_text(text)
    for path in (str(tmp_path), str(tmp_path / "feed.zip")):
        stops = readers.gtfs_stops(spark, path, feed="rodalies")
        assert sorted(r.stop_id for r in stops.collect()) == ["s1", "s2"]
        table = lambda n, c: readers.gtfs_table(spark, path, n, c)  # noqa: B023, E731
        services = transit.active_services(None, table("calendar_dates", ("service_id", "date", "exception_type")), 0)
        assert sorted(r.service_id for r in services.collect()) == ["h", "w"]
        got = transit.frequency(stops, table("trips", ("trip_id", "service_id")), table("stop_times", ("trip_id", "stop_id")), services).collect()
        assert {(r.stop_id, r.trips_per_day, r.trips_to_bcn_core) for r in got} == {("s1", 1, 1), ("s2", 3, 1)}
    calendar = spark.createDataFrame([("c", "1"), ("d", "0")], "service_id string, monday string")
    assert [r.service_id for r in transit.active_services(calendar, None, 0).collect()] == ["c"]
    sunday = transit.active_services(None, table("calendar_dates", ("service_id", "date", "exception_type")), 6)
    assert sorted(r.service_id for r in sunday.collect()) == ["h", "w"]  # no date is a Sunday: those of the date with most rows
    some = spark.createDataFrame([("c", "0")], "service_id string, monday string")
    assert transit.active_services(some, table("calendar_dates", ("service_id", "date", "exception_type")), 0).count() == 0  # a calendar is final


def test_stations_facilities_hospitals(spark, tmp_path):
    (tmp_path / "air.csv").write_text("codi_estacio,nom_estacio,longitud,latitud,any,no2_anual,pm25_anual,pm10_anual,o3_max8h\n08019004,A,2.1,41.4,2023,30.5,1,2,3\n08019005,B,2.2,41.5,2023,,1,2,3\n")
    air = readers.air_stations(spark, str(tmp_path / "air.csv")).orderBy("station_id").collect()
    assert air[0].station_id == "08019004" and air[0].operator == "XVPCA" and air[1].no2_annual_ugm3 is None
    (tmp_path / "f.csv").write_text("FacilityID,FacilityName,Long,Lat,PollutantReleaseAndTransferQuantityKg\n1,F,2.0,41.0,5000\n2,G,bad,41,1\n3,H,9.0,41.0,1\n")
    assert [(r.facility_id, r.total_emissions_t) for r in readers.facilities(spark, str(tmp_path / "f.csv")).collect()] == [("1", 5.0)]
    (tmp_path / "h.csv").write_text("CODI,NOM,LONGITUD,LATITUD\nH1,Clinic,2.1,41.3\n")
    assert readers.hospitals(spark, str(tmp_path / "h.csv")).first().tags["code"] == "H1"
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.hospitals(spark, str(tmp_path / "x.csv"))
    wide = spark.createDataFrame([("s", "1", "3"), ("s", None, "x")], "id string, h01 string, h02 string")
    assert sorted((r.hour, r.value) for r in readers.hourly_to_long(wide, ["id"]).where("value is not null").collect()) == [(1, 1.0), (2, 3.0)]


def test_paged_observations(spark, tmp_path):
    for k in range(3):
        body = {"results": [{"key": 10 * k + i, "decimalLongitude": 2.0 + i, "decimalLatitude": 41.0, "year": 2024, "kingdom": "Plantae", "occurrenceStatus": None if i else "ABSENT"} for i in range(3)], "endOfRecords": k == 2}
        (tmp_path / f"page-{3 * k}.json").write_text(json.dumps(body))
    spark.dataSource.register(readers.PagedSource)
    frame = spark.read.format("paged_observations").option("path", str(tmp_path)).option("limit", 3).option("pages", 5).option("partitions", 2).load()
    assert frame.count() == 9 and readers.observations(frame).count() == 6 and readers.observations(frame, most=4).count() == 4


def test_reach(spark):
    from flowgrid.sources import reach

    stations = spark.createDataFrame([("a", 41.0, 2.0), ("bad", 41.0, 2.0)], "station_id string, lat double, lon double")
    asked = reach.requests(stations)
    cached = asked.where("station_id = 'a' and minutes = 15").select("cache_key", F.lit("{}").alias("geojson"))

    def call(station, lat, lon, minutes):
        if station == "bad":
            raise OSError("no route")
        return json.dumps({"minutes": minutes})

    got = {(r.station_id, r.minutes): (r.source, r.geojson, r.error) for r in reach.answers(asked, cached, call).collect()}
    assert got == {("a", 15): ("cache", "{}", None), ("a", 25): ("fresh", '{"minutes": 25}', None), ("bad", 15): ("failed", None, "no route"), ("bad", 25): ("failed", None, "no route")}


def test_fields_and_combination(spark):
    from flowgrid.functions.fields import FIELDS
    from flowgrid.operators import combine

    assert len(FIELDS) == 42 and FIELDS["uhi_delta_c"].pivot == 0.0 and FIELDS["night_share"].season == "night"
    cells = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "cell string, v double")
    feature = spark.createDataFrame([("a", 9.0)], "cell string, w double")
    assert sorted((r.cell, r.v, r.w) for r in combine.compose(cells, [feature]).collect()) == [("a", 1.0, 9.0), ("b", 2.0, None)]
    assert [r.value for r in combine.season_value(cells, feature, "v", None).orderBy("cell").collect()] == [1.0, 2.0]


def test_plan_files():
    files = readers.plan_files("daily", [datetime.date(2024, 10, 15)])
    assert files[0].name == "20241015_Viajes_distritos.csv.gz" and files[0].url.endswith("/ficheros-diarios/2024-10/20241015_Viajes_distritos.csv.gz")
    with pytest.raises(ValueError):
        readers.plan_files("weekly", [])


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", float("nan"), 1.26, 3.0), ("b", 2.0, None, float("inf"))], "cell string, x double, y double, z double")
    sinks.write_records(frame, str(tmp_path / "r"), {"y": 1})
    rows = {r["cell"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "r")).collect()))}
    assert rows["a"] == {"cell": "a", "x": None, "y": 1.3, "z": 3.0} and rows["b"]["z"] is None
    pinned = dict(display.pin_integers(spark.createDataFrame([(1.0, 1.5), (None, 2.0)], "i double, f double")).dtypes)
    assert pinned == {"i": "bigint", "f": "double"}
    sinks.write_page(str(tmp_path / "p.html"), "T", frame)
    assert json.loads(readers.payload(spark, str(tmp_path / "p.html")).first().json)["cells"][0]["cell"] == "a"
    seasons = spark.createDataFrame([("a", "feb", 1.0), ("a", "jun", 2.0)], "cell string, season string, v double")
    assert json.loads(sinks.season_objects(seasons, {"v": "s"}).first().json) == {"feb": {"s": 1.0}, "jun": {"s": 2.0}}
    assert json.loads(sinks.manifest(spark.createDataFrame([(1.0, 50.0), (None, 70.0)], "f double, liveability_score double"), ["f"]))["coverage"] == {"f": 0.5}
    (tmp_path / "arcs.json").write_text('[{"source": [2.0, 41.0], "target": [2.1, 41.1], "value": 3.0}, {"o_lon": 1.0, "o_lat": 2.0, "d_lon": 3.0, "d_lat": 4.0, "viajes": 5.0}]')
    assert sorted(r.value for r in readers.parse_arcs(spark, str(tmp_path / "arcs.json")).collect()) == [3.0, 5.0]


# Places, scores, display


def test_places(spark):
    rows = [(1, {"sport": "climbing"}), (2, {"leisure": "garden", "sport": "yoga"}), (3, {"shop": "bakery"}), (4, None), (5, {}), (6, {"landuse": "industrial"})]
    frame = spark.createDataFrame(rows, "id long, tags map<string,string>")
    assert {r.id: r.category for r in places.categorise(frame).collect()} == {1: "climbing", 2: "yoga", 6: "industry"}
    assert [r.id for r in places.categorise(frame, ["park"]).collect()] == [2]
    assert places.categorise(frame.limit(0)).count() == 0
    elements = spark.createDataFrame(
        [(1, "node", (2.0, 41.0), None, {"railway": "station", "name": "S"}), (2, "node", (2.1, 41.1), None, None), (9, "way", None, [2, 1], {"highway": "motorway"}), (8, "way", None, [1, 2], {"natural": "coastline"})],
        "id long, kind string, location struct<longitude:double,latitude:double>, refs array<long>, tags map<string,string>",
    )
    assert [(r.stop_id, r.stop_name, r.trips_per_day, r.feed) for r in places.stations(elements).collect()] == [("1", "S", 12, "osm")] and places.coastlines(elements).count() == 1
    line = places.network(elements).first()
    assert (line.osm_id, line.kind, line.subtype, [p.x for p in line.line]) == (9, "highway", "motorway", [2.1, 2.0])


def test_scores(spark):
    frame = spark.createDataFrame([("near", 5.0, 100.0, True), ("far", 40.0, 9000.0, False), ("none", None, None, None)], "cell string, train_reach_min double, climb_min_m double, natura2000_within_5km boolean")
    s = {r.cell: r.liveability_score for r in score.with_score(frame).collect()}
    assert s["near"] == pytest.approx(50 + 20 * 1.4 + 5 * 0.99 + 5) and s["far"] == pytest.approx(50.5) and s["none"] == 50 and s["near"] > s["far"] > s["none"]
    assert score.load_weights("quiet_strict")["uhi_per_degree"] == -6.0 and score.load_weights("quiet_strict")["climb_reward"] == 5.0
    with pytest.raises(KeyError):
        score.load_weights("loud")
    overlap = {(r.a, r.b): r.jaccard for r in score.sensitivity(frame, k=1).collect()}
    assert overlap["default", "default"] == 1.0
    colours = spark.createDataFrame([(0.0,), (12.5,), (100.0,), (None,)], "s double").select(display.score_colour(F.col("s")).alias("c")).collect()
    assert [r.c for r in colours] == [[58, 31, 93], [90, 38, 101], [255, 209, 102], None]


# Geometry


def test_projection(spark):
    x, y = geo.utm(F.lit(2.1734), F.lit(41.3851))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), *[c.alias(n) for c, n in zip(geo.lonlat(x, y), ("lon", "lat"), strict=True)]).first()
    assert abs(r.x - 430887.564) < 0.01 and abs(r.y - 4581837.853) < 0.01
    assert abs(r.lon - 2.1734) < 1e-8 and abs(r.lat - 41.3851) < 1e-8


def test_lattice(spark):
    rng = random.Random(4)
    pts = spark.createDataFrame([(rng.uniform(0, 5e4), rng.uniform(0, 5e4)) for _ in range(300)], "x double, y double")
    q, r = geo.cell_axes(F.col("x"), F.col("y"))
    placed = pts.withColumns({"q": q, "r": r, "cell": geo.cell_of(F.col("x"), F.col("y"))})
    held = placed.select(geo.contains(F.array(geo.cell_ring(F.col("q"), F.col("r"))), F.col("x"), F.col("y")).alias("h"), F.length("cell").alias("n"), (geo.axes_of(F.col("cell"))[0] == F.col("q")).alias("same")).collect()
    assert all(h.h and h.n == 15 and h.same for h in held)
    ring = spark.range(1).select(geo.area(F.array(geo.cell_ring(F.lit(3), F.lit(4)))).alias("a")).first().a
    assert ring == pytest.approx(geo.CELL_AREA)


def test_hex_crosswalk_closes(spark):
    shell = [{"x": 0.0, "y": 0.0}, {"x": 9000.0, "y": 500.0}, {"x": 4000.0, "y": 3000.0}, {"x": 8000.0, "y": 9000.0}, {"x": 500.0, "y": 7000.0}]
    hole = [{"x": 1500.0, "y": 2000.0}, {"x": 2500.0, "y": 2000.0}, {"x": 2500.0, "y": 3500.0}, {"x": 1500.0, "y": 3500.0}]
    flat = [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 0.0}, {"x": 9.0, "y": 0.0}]
    zones = spark.createDataFrame([("z", [shell, hole, flat])], "zone string, polygon array<array<struct<x:double,y:double>>>")
    weights = spatial.hex_crosswalk(zones)
    r = flows.closure(weights).first()
    assert r.least == pytest.approx(1) and weights.count() > 40
    whole = spatial.overlay_weights(zones, spark.createDataFrame([("all", [{"x": -1e4, "y": -1e4}, {"x": 2e4, "y": -1e4}, {"x": 2e4, "y": 2e4}, {"x": -1e4, "y": 2e4}])], "cell string, ring array<struct<x:double,y:double>>"))
    assert [(w.cell, w.weight) for w in whole.collect()] == [("all", 1.0)]
    full, centred = spatial.hex_cover(zones).count(), spatial.hex_cover(zones, full=False).count()
    assert full > centred > 0
    triangle = spark.createDataFrame([("t", [[(0.0, 0.0), (12000.0, 0.0), (0.0, 12000.0), (0.0, 0.0)]])], "zone string, polygon array<array<struct<x:double,y:double>>>")
    cells = {c.cell: [(p.x, p.y) for p in c.ring] for c in spatial.hex_cover(triangle).collect()}
    boxed = triangle.withColumn("polygon", F.expr("array(transform(array(0, 1, 2, 3, 0), i -> struct(if(i in (1, 2), 12000D, 0D) as x, if(i in (2, 3), 12000D, 0D) as y)))"))
    inside = {c.cell: [(p.x, p.y) for p in c.ring] for c in spatial.hex_cover(boxed).collect()}
    shape = [[(0.0, 0.0), (12000.0, 0.0), (0.0, 12000.0), (0.0, 0.0)]]
    assert set(cells) == {c for c, ring in inside.items() if spatial.clip_area(shape, ring) > spatial.SLIVER} and len(cells) < len(inside)
    assert {w.cell for w in spatial.hex_crosswalk(triangle).collect()} == set(cells)
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert spatial.clip_area([[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]], ring) == 1.0 and spatial.clip_area([[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]], ring) == 0.0


def test_density_clusters_and_hulls(spark):
    rng = random.Random(9)
    pts = [(i, cx + rng.uniform(-5, 5), cy + rng.uniform(-5, 5)) for i, (cx, cy) in enumerate([(0, 0)] * 30 + [(100, 100)] * 30)] + [(99, 500.0, 500.0)]
    frame = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.cluster for r in spatial.cluster_points(frame, 6.0, 4).collect()}
    assert got[99] is None and {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 60)} == {30}
    square = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(5) for y in range(5))]
    hull = spatial.convex_hulls(spark.createDataFrame(square, "id long, x double, y double").withColumn("g", F.lit("k")), "g").first().ring
    assert {(p.x, p.y) for p in hull} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def crowds(n: int, seed: int) -> list[tuple[int, float, float]]:
    """Points on whole metres: a tight crowd, copies of one place, a loose field across the origin and two far off."""
    rng = random.Random(seed)
    at = lambda i: (rng.randint(50, 60), rng.randint(-60, -50)) if i % 3 == 0 else (7, 7) if i % 3 == 1 else (rng.randint(-400, 400), rng.randint(-400, 400))
    return [(i, *map(float, at(i))) for i in range(n)] + [(n, 5000.0, 5000.0), (n + 1, 5000.0, 5100.0)]


def test_k_nearest_in_crowds(spark):
    left, right = crowds(120, 1), crowds(200, 2)
    frames = [spark.createDataFrame(p, "id long, x double, y double") for p in (left, right)]
    for cap, k in ((100.0, 3), (1000.0, 1), (1000.0, 5), (1.0, 3)):
        want = sorted((i, j, d, n) for i, x, y in left for n, (d, j) in enumerate(sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in right)[:k], 1) if d <= cap)
        assert sorted(map(tuple, spatial.k_nearest(*frames, cap, k).collect())) == want
    assert spatial.k_nearest(frames[0], frames[1].where("false"), 100.0, 3).count() == 0


def test_k_nearest_of_many_in_a_tile(spark):
    """3.6e9 pairs lie within the cap: comparing them all is stopped."""
    square = spark.range(60_000).selectExpr("id", "cast(id * 7919 % 60000 as double) as x", "cast(id * 10473 % 60000 as double) as y")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    got = spatial.k_nearest(square, square, 90_000.0, 3).agg(F.count("*"), F.count_if(F.expr("rank = 1 and id = r_id and distance = 0"))).first()
    stop.cancel()
    assert tuple(got) == (180_000, 60_000)


def test_density_clusters_as_defined(spark):
    """Crowds, copies, noise, and tiles that only a pair of inner points links, against the definition."""
    pts, r = crowds(150, 3) + [(900 + i, 1000.0 + 40 * i, 9.0 * (i % 2)) for i in range(12)], 41.0
    beside = {i: [j for j, u, v in pts if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= r] for i, x, y in pts}
    for least in (1, 2, 5):
        core, want = {i for i in beside if len(beside[i]) >= least}, {}
        for i in sorted(core):
            reached = [i] if i not in want else []
            while reached:
                j = reached.pop()
                if j not in want:
                    want[j] = i
                    reached += [n for n in beside[j] if n in core]
        want |= {i: min((want[j] for j in beside[i] if j in core), default=None) for i in beside if i not in core}
        assert dict(map(tuple, spatial.cluster_points(spark.createDataFrame(pts, "id long, x double, y double"), r, least).collect())) == want


def test_density_clusters_without_a_place(spark):
    """Points with a coordinate that is null, NaN or infinite are noise, though NaN's tile is that of the origin's crowd."""
    nan, inf = math.nan, math.inf
    pts = [(i, 1.0 + i, 1.0 + i) for i in range(5)] + [(10, nan, nan), (11, nan, 2.0), (12, 1.0, nan), (13, inf, 1.0), (14, 1.0, -inf), (15, None, 1.0), (16, None, None)]
    got = spatial.cluster_points(spark.createDataFrame(pts, "id long, x double, y double"), 20.0, 4).collect()
    assert dict(map(tuple, got)) == {i: 0 if i < 5 else None for i, _, _ in pts}


def test_density_clusters_of_many_in_reach(spark):
    """Two crowds of 50,000 within one radius each, farther apart than that: comparing all 5e9 pairs is stopped."""
    crowds = spark.range(100_000).selectExpr("id", "cast(id * 7919 % 30000 + id % 2 * 90000 as double) as x", "cast(id * 10473 % 30000 as double) as y")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    got = spatial.cluster_points(crowds, 45_000.0, 4).groupBy("cluster").count().collect()
    stop.cancel()
    assert sorted(map(tuple, got)) == [(0, 50_000), (1, 50_000)]


def test_streaming_totals(spark, tmp_path):
    from flowgrid.streaming.rollup import windowed_totals

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_totals(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == events.count()


def test_nearest_in_blocks(spark):
    """Every id divisible by 20 is asked for, and small blocks give what one block gives."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = catalog.QUERIES["knn_embeddings_by_20"](spark, SF)
    assert {r.id for r in got.select("id").distinct().collect()} == {r.vec_id for r in e.where("vec_id % 20 = 0").collect()}
    small = catalog.nearest_of_label(e, F.col("vec_id") % 20 == 0, 3, query_rows=2, rows=7)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got.collect()))


def test_bronze_splits_a_large_day(spark, tmp_path):
    from flowgrid.sources import sinks

    rows = spark.range(0, 60_000, 1, 8).selectExpr("if(id < 100, '20240101', '20240102') as fecha", "sha2(cast(id as string), 256) as origen", "cast(id as double) as viajes")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        sinks.write_bronze(rows, str(tmp_path), zoning="districts", kind="daily")
    finally:
        spark.conf.set(size, before)
    back = spark.read.parquet(str(tmp_path))
    assert {(r.fecha, r.n) for r in back.groupBy(F.col("fecha").cast("string")).agg(F.count("*").alias("n")).collect()} == {("20240101", 100), ("20240102", 59_900)}
    files = lambda day: len(list(tmp_path.glob(f"zoning=districts/kind=daily/fecha={day}/*.parquet")))
    assert files("20240102") > 1 and files("20240101") <= 8
