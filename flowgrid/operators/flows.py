"""The algebra of origin-destination cubes.

A cube row is (day, hour, origin, dest, band, act_o, act_d, income, age, sex) with trips and trip_km.
Zones are spread over cells by a crosswalk (zone, cell, weight).  Everything is aggregated by zone
before it meets the crosswalk, so the join is of zones and not of trips; quotients are always taken of
sums of weighted parts, never averaged.  The crosswalk isn't hinted: it is broadcast where the planner
finds it small, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Activities and month windows.
LEISURE = ("frecuente", "no_frecuente")
COMMUTE = ("trabajo_estudio",)
SEASONS = {"02": "feb", "05": "may", "06": "jun"}
LONG_BANDS = ("50-100", ">100")
#: First and last hours of the day's parts, inclusive.
HOUR_BANDS = {"am_peak_share": ((7, 9),), "pm_peak_share": ((17, 19),), "midday_share": ((11, 15),), "night_share": ((0, 5), (22, 23))}
DAY_PARTS = (("morning", 5, 10), ("midday", 11, 15), ("evening", 16, 19))
#: The wider variant of both.
WIDE_BANDS = {"am_peak_share": ((7, 9),), "pm_peak_share": ((17, 20),), "midday_share": ((11, 14),), "night_share": ((0, 5), (22, 23))}
WIDE_PARTS = (("morning", 6, 10), ("midday", 11, 15), ("evening", 16, 21))
SEGMENTS = ("income", "age", "sex")
CUBE_KEYS = ("day", "origin", "dest", "band", "act_o", "act_d", "income", "age", "sex")


def guarded(num: Column, den: Column) -> Column:
    """num / den, null where den isn't positive."""
    return num / F.when(den > 0, den)


def sum_if(condition: Column, value: str = "trips") -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0.0))


def log_balance(out: Column, into: Column) -> Column:
    return F.log(F.greatest(out, F.lit(1.0)) / F.greatest(into, F.lit(1.0)))


def season_of(day: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEASONS.items() for x in kv]), F.substring(day, 5, 2))


# Scans and the silver layer


def endpoint_prefix(prefixes: Sequence[str], columns: Sequence[str] = ("origin", "dest")) -> Column:
    """Rows with either endpoint under a prefix; startswith reaches the Parquet scan, substring wouldn't."""
    tests = [F.col(c).startswith(p) for c in columns for p in prefixes]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def day_window(first: str | None, last: str | None) -> Column:
    """Days from first to last, both inclusive, as strings."""
    out = F.lit(True)
    if first:
        out = out & (F.col("day") >= first)
    if last:
        out = out & (F.col("day") <= last)
    return out


def silver(cube: DataFrame) -> DataFrame:
    """Dates and day types added; unknown segments become a bucket 'NA' and are never dropped."""
    return cube.withColumns(_calendar() | {"support": F.lit(1), "season": season_of(F.col("day"))} | {s: F.coalesce(F.col(s), F.lit("NA")) for s in SEGMENTS})


def _calendar() -> dict[str, Column]:
    date = F.to_date("day", "yyyyMMdd")
    return {"date": date, "weekday": F.dayofweek(date), "is_weekend": F.dayofweek(date).isin(1, 7)}


def daily_rollup(od: DataFrame) -> DataFrame:
    """Sums by day, ends and segments; what follows from the day is no key, but derived again."""
    sums = od.groupBy(*CUBE_KEYS).agg(*[F.sum(c).alias(c) for c in ("trips", "trip_km", "support")])
    return sums.withColumns(_calendar()).select(*CUBE_KEYS, "date", "weekday", "is_weekend", "trips", "trip_km", "support")


# Disaggregation


def spread(zones: DataFrame, xwalk: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Additive values of zones, spread over cells by weight."""
    parts = [F.sum(F.col(v) * F.col("weight")).alias(v) for v in dict.fromkeys(values)]
    return zones.join(xwalk, "zone").groupBy("cell", *keys).agg(*parts)


def spread_ratios(zones: DataFrame, xwalk: DataFrame, ratios: dict[str, tuple[str, str]], keys: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """Quotients at cells, of spread numerators and denominators; the spread parts stay as columns."""
    parts = [*dict.fromkeys([c for pair in ratios.values() for c in pair]), *also]
    return spread(zones, xwalk, parts, keys).withColumns({k: guarded(F.col(n), F.col(d)) for k, (n, d) in ratios.items()})


def spread_average(zones: DataFrame, xwalk: DataFrame, values: Sequence[str]) -> DataFrame:
    """Weighted averages over a cell's zones with a value: an approximation where the value is a ratio."""
    known = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))
    return xwalk.join(zones, "zone", "left").groupBy("cell").agg(*[guarded(F.sum(F.col(v) * F.col("weight")), known(v)).alias(v) for v in values])


def spread_label(zones: DataFrame, xwalk: DataFrame, label: str) -> DataFrame:
    """Each cell's label: that of its zone of greatest weight (ties: the greatest code)."""
    return xwalk.join(zones, "zone").groupBy("cell").agg(F.max_by(label, F.struct("weight", "zone")).alias(label))


def dominant_cells(xwalk: DataFrame) -> DataFrame:
    """Each zone's cell of greatest weight (ties: the least cell)."""
    best = F.row_number().over(W.partitionBy("zone").orderBy(F.desc("weight"), "cell"))
    return xwalk.withColumn("r", best).where("r = 1").select("zone", "cell", "weight")


def closure(xwalk: DataFrame) -> DataFrame:
    """Sums of weights by zone: count, least, greatest, mean and median; all ones if nothing is lost."""
    sums = xwalk.groupBy("zone").agg(F.sum("weight").alias("s"))
    return sums.agg(F.count("*").alias("zones"), F.min("s").alias("least"), F.max("s").alias("greatest"), F.avg("s").alias("mean"), F.median("s").alias("median"))


def centroid_totals(od: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The naive attribution kept for comparison: each zone's window totals, whole, at every cell of it."""
    zones = both_ways(od.groupBy("origin", "dest").agg(F.sum("trips").alias("trips")), {"inflow": "trips"}, {"outflow": "trips"})
    return xwalk.join(zones, "zone", "left").select("cell", "zone", "inflow", "outflow")


# Flows in and out


def both_ways(pairs: DataFrame, into: dict[str, str], out: dict[str, str], keys: Sequence[str] = (), also: Sequence[Column] = ()) -> DataFrame:
    """(zone, keys, into..., out...): sums of pairs' columns by destination (into) and by origin (out), null where a zone has none.

    Each pair is read once, and counts at both its ends.
    """
    none = lambda names: [F.lit(None).cast("double").alias(k) for k in names]
    arrive = F.struct(F.col("dest").alias("zone"), *[F.col(c).cast("double").alias(k) for k, c in into.items()], *none(out))
    leave = F.struct(F.col("origin").alias("zone"), *none(into), *[F.col(c).cast("double").alias(k) for k, c in out.items()])
    ends = pairs.select(*keys, *also, F.inline(F.array(arrive, leave)))
    return ends.groupBy("zone", *keys).agg(*[F.sum(k).alias(k) for k in (*into, *out)], *[F.collect_set(a).alias(f"{a}s") for a in also])


def inflow_outflow(od: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Trips a day into and out of each cell, over all days of the data, their quotient and its balance in logs."""
    pairs = od.groupBy("origin", "dest", "day").agg(F.sum("trips").alias("trips"))
    zones = both_ways(pairs, {"inflow": "trips"}, {"outflow": "trips"}, also=["day"]).na.fill(0.0, ["inflow", "outflow"])
    # The window is over zones, each with its set of days.
    days = F.size(F.array_distinct(F.flatten(F.collect_list("days").over(W.partitionBy()))))
    per_day = zones.withColumn("n", F.greatest(days, F.lit(1))).select("zone", *[(F.col(c) / F.col("n")).alias(c) for c in ("inflow", "outflow")])
    cells = spread(per_day, xwalk, ["inflow", "outflow"])
    return cells.withColumns({"through": guarded(F.col("outflow"), F.col("inflow")), "log_through": log_balance(F.col("outflow"), F.col("inflow"))})


def inflow_outflow_mean(od: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The variant that averages the totals of the days on which a zone occurs."""
    pairs = od.groupBy("origin", "dest", "day").agg(F.sum("trips").alias("trips"))
    daily = both_ways(pairs, {"inflow": "trips"}, {"outflow": "trips"}, ["day"])
    zones = daily.groupBy("zone").agg(F.avg("inflow").alias("inflow"), F.avg("outflow").alias("outflow")).na.fill(0.0)
    cells = spread(zones, xwalk, ["inflow", "outflow"])
    return cells.withColumn("log_through", F.log((F.col("outflow") + 1) / (F.col("inflow") + 1)))


# Rhythm


def hour_shares(od: DataFrame, xwalk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(cell, keys, hour, flow, share): each cell's arrivals by hour as shares of its day."""
    zones = od.groupBy(F.col("dest").alias("zone"), *keys, "hour").agg(F.sum("trips").alias("flow"))
    cells = spread(zones, xwalk, ["flow"], [*keys, "hour"])
    day = F.sum("flow").over(W.partitionBy("cell", *keys))
    return cells.withColumn("share", guarded(F.col("flow"), day))


def day_part(hour: Column, parts=DAY_PARTS) -> Column:
    out = F.when(F.lit(False), "")
    for name, first, last in parts:
        out = out.when(hour.between(first, last), name)
    return out.otherwise("night")


def rhythm(shares: DataFrame, keys: Sequence[str] = (), bands=None, parts=DAY_PARTS) -> DataFrame:
    """Shares of the day's parts, and the hour of the greatest flow (ties: the earliest)."""
    inside = lambda spans: sum((sum_if(F.col("hour").between(a, b), "share") for a, b in spans[1:]), sum_if(F.col("hour").between(*spans[0]), "share"))
    peak = F.max_by("hour", F.struct("flow", -F.col("hour"))).alias("peak_hour")
    out = shares.groupBy("cell", *keys).agg(*[inside(s).alias(k) for k, s in (bands or HOUR_BANDS).items()], peak)
    return out.withColumn("peak_part", day_part(F.col("peak_hour"), parts))


def hourly_rhythm(od: DataFrame, xwalk: DataFrame, keys: Sequence[str] = (), bands=None, parts=DAY_PARTS, places: int = 9) -> DataFrame:
    """The same for cells from a cube: one row with 24 sums a zone meets the crosswalk, and one a cell comes out.

    Flows are compared to that many places, so that a peak doesn't hang on the order of a sum.
    """
    hours = [f"h{h}" for h in range(24)]
    zones = od.groupBy(F.col("dest").alias("zone"), *keys).agg(*[sum_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)])
    cells = spread(zones, xwalk, hours, keys)
    day = sum((F.col(h) for h in hours[1:]), F.col(hours[0]))
    inside = lambda spans: sum((guarded(F.col(f"h{h}"), day) for a, b in spans for h in range(a, b + 1)), F.lit(0.0))
    peak = F.array_max(F.array(*[F.struct(F.round(f"h{h}", places).alias("flow"), F.lit(-h).alias("back")) for h in range(24)]))
    out = cells.select("cell", *keys, *[inside(s).alias(k) for k, s in (bands or HOUR_BANDS).items()], (-peak["back"]).alias("peak_hour"))
    return out.withColumn("peak_part", day_part(F.col("peak_hour"), parts))


def hour_vector(shares: DataFrame) -> DataFrame:
    """One row a cell: 24 shares in order of the hour, zero where none."""
    entries = F.map_from_entries(F.collect_list(F.struct("hour", "share")))  # 24 at most
    by_hour = shares.groupBy("cell").agg(entries.alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0.0)))
    return by_hour.select("cell", slots.alias("profile"))


# Weekends


def _weekends(od: DataFrame, xwalk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(cell, keys, ratios, support_n, weekday_trips): one pass over the cube gives daily totals by day type and their activities."""
    zone = F.col("dest").alias("zone")
    daily = od.groupBy(zone, *keys, "day", "is_weekend").agg(
        F.sum("trips").alias("v"),
        F.sum("support").alias("support"),
        sum_if(F.col("act_d").isin(*LEISURE)).alias("leisure"),
        sum_if(F.col("act_d").isin(*COMMUTE)).alias("commute"),
    )
    mean_on = lambda weekend: F.coalesce(F.avg(F.when(F.col("is_weekend") == weekend, F.col("v"))), F.lit(0.0))
    zones = daily.groupBy("zone", *keys).agg(
        mean_on(True).alias("weekend_mean"), mean_on(False).alias("weekday_mean"), F.sum("support").cast("double").alias("support_n"),
        F.sum("leisure").alias("leisure"), F.sum("commute").alias("commute"), F.sum("v").alias("total"),
        F.sum(F.when(~F.col("is_weekend"), F.col("v"))).alias("weekday_trips"),
    )
    ratios = {"weekend_ratio": ("weekend_mean", "weekday_mean"), "leisure_share": ("leisure", "total"), "commute_share": ("commute", "total")}
    return spread_ratios(zones, xwalk, ratios, keys, ["support_n", "weekday_trips"]).select("cell", *keys, "support_n", "weekday_trips", *ratios)


def weekend_hotspots(od: DataFrame, xwalk: DataFrame, *, keys: Sequence[str] = (), min_support: float = 50, leisure_offset: float = 0.5) -> DataFrame:
    """How much more a cell draws on a weekend day than on a weekday, weighted by its leisure trips.

    Means are over the days with data.  The score is null under the least support.
    """
    score = F.when(F.col("support_n") >= min_support, F.col("weekend_ratio") * (leisure_offset + F.col("leisure_share")))
    return _weekends(od, xwalk, keys).withColumn("hotspot_score", score).drop("weekday_trips")


def weekend_hotspots_gated(od: DataFrame, xwalk: DataFrame, *, min_weekday: float = 100) -> DataFrame:
    """The variant gated on weekday trips, with full weight on the ratio."""
    score = F.when(F.col("weekday_trips") >= min_weekday, F.col("weekend_ratio") * (1 + F.coalesce("leisure_share", F.lit(0.0))))
    return _weekends(od, xwalk).select("cell", "weekend_ratio", "leisure_share", "weekday_trips", score.alias("hotspot_score"))


def seasonal_wide(frame: DataFrame, measures: Sequence[str], first: str = "feb", last: str = "jun") -> DataFrame:
    """A column for each measure and season, and each measure's change from the first to the last season."""
    pick = lambda m, s: F.first(F.when(F.col("season") == s, F.col(m)), ignorenulls=True).alias(f"{m}_{s}")
    wide = frame.groupBy("cell").agg(*[pick(m, s) for m in measures for s in SEASONS.values()])
    return wide.withColumns({f"{m}_delta": F.col(f"{m}_{last}") - F.col(f"{m}_{first}") for m in measures})


# Who travels


GEODEMO = {
    "female_share": ("female", "known_sex"), "youth_share": ("youth", "known_age"), "senior_share": ("senior", "known_age"),
    "low_income_share": ("low_income", "known_income"), "female_of_all": ("female", "total"), "youth_of_all": ("youth", "total"),
    "senior_of_all": ("senior", "total"), "low_income_of_all": ("low_income", "total"), "sex_coverage": ("known_sex", "total"),
    "age_coverage": ("known_age", "total"), "income_coverage": ("known_income", "total"),
}


def geodemographic(od: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Shares of arrivals over the known part of each segment and over all, and the known parts."""
    tests = {
        "female": F.col("sex") == "mujer", "youth": F.col("age") == "0-25", "senior": F.col("age") == "65-100", "low_income": F.col("income") == "<10",
        "known_sex": F.col("sex").isin("hombre", "mujer"), "known_age": F.col("age") != "NA", "known_income": F.col("income") != "NA",
    }
    zones = od.groupBy(F.col("dest").alias("zone")).agg(F.sum("trips").alias("total"), *[sum_if(t).alias(k) for k, t in tests.items()])
    return spread_ratios(zones, xwalk, GEODEMO).select("cell", *GEODEMO)


def entropy_bits(od: DataFrame, xwalk: DataFrame, by: Sequence[str] = ("income", "age")) -> DataFrame:
    """Shannon entropy of each cell's joint histogram, from spread counts."""
    zones = od.groupBy(F.col("dest").alias("zone"), *by).agg(F.sum("trips").alias("n"))
    cells = spread(zones, xwalk, ["n"], by)
    p = guarded(F.col("n"), F.sum("n").over(W.partitionBy("cell")))
    bits = F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)
    return cells.withColumn("p", p).groupBy("cell").agg((-F.sum(bits)).alias("diversity"))


def entropy_by_zone(od: DataFrame, xwalk: DataFrame, by: Sequence[str] = ("income", "age")) -> DataFrame:
    """The variant that averages the zones' own entropies."""
    counts = od.groupBy(F.col("dest").alias("zone"), *by).agg(F.sum("trips").alias("n"))
    p = guarded(F.col("n"), F.sum("n").over(W.partitionBy("zone")))
    bits = F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)
    zones = counts.withColumn("p", p).groupBy("zone").agg((-F.sum(bits)).alias("diversity"))
    return spread_average(zones, xwalk, ["diversity"])


# Typology


TYPOLOGY = {"intra_share": ("intra", "tot_in"), "long_share": ("long", "tot_in"), "leisure_share": ("leisure", "tot_in"), "commute_share": ("commute", "tot_in")}
#: Which feature's high pole names a cluster.
POLES = {"intra_share": "self-contained", "leisure_share": "leisure-magnet", "commute_share": "commuter-corridor", "long_share": "transit-corridor"}


def typology_parts(od: DataFrame, long_bands: Sequence[str] = LONG_BANDS) -> DataFrame:
    """(zone, tot_in, intra, long, leisure, commute, tot_out), in one pass over the cube."""
    pairs = od.groupBy("origin", "dest").agg(
        F.sum("trips").alias("tot"),
        sum_if(F.col("origin") == F.col("dest")).alias("intra"),
        sum_if(F.col("band").isin(*long_bands)).alias("long"),
        sum_if(F.col("act_d").isin(*LEISURE)).alias("leisure"),
        sum_if(F.col("act_d").isin(*COMMUTE)).alias("commute"),
    )
    into = {"tot_in": "tot"} | {k: k for k in ("intra", "long", "leisure", "commute")}
    return both_ways(pairs, into, {"tot_out": "tot"}).na.fill(0.0)


def typology_indices(od: DataFrame, xwalk: DataFrame, long_bands: Sequence[str] = LONG_BANDS) -> DataFrame:
    zones = typology_parts(od, long_bands)
    cells = spread_ratios(zones, xwalk, TYPOLOGY, also=["tot_out"])
    return cells.select("cell", *TYPOLOGY, log_balance(F.col("tot_out"), F.col("tot_in")).alias("sink_source"))


def name_clusters(centers: Sequence[Sequence[float]], features: Sequence[str], least: float = 0.5) -> list[str]:
    """Names of clusters by their standardised centers.

    The cluster with the most extreme feature chooses first.  A cluster takes the name of its most
    extreme high pole that is still free; features less extreme than the least give none.
    """
    names = ["mixed-balanced"] * len(centers)
    taken: set[str] = set()
    strength = lambda c: max((abs(x) for x in c), default=0.0)
    for i in sorted(range(len(centers)), key=lambda i: -strength(centers[i])):
        by_strength = sorted(zip(features, centers[i], strict=True), key=lambda fx: -abs(fx[1]))
        free = (POLES[f] for f, x in by_strength if x >= least and f in POLES and POLES[f] not in taken)
        names[i] = next(free, "mixed-balanced")
        taken.add(names[i])
    return names


def typology(indices: DataFrame, *, k: int = 5, seed: int = 42, key: str = "cell") -> DataFrame:
    """Cells clustered by their indices: (key, cluster, label). Constant features are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    features = list(TYPOLOGY)
    filled = indices.select(key, *features).na.fill(0.0, features).sort(key)
    spread_of = filled.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    used = [f for f in features if (spread_of[f] or 0) > 1e-9]
    if not used:
        return filled.select(key, F.lit(0).alias("cluster"), F.lit("mixed-balanced").alias("label"))
    vectors = VectorAssembler(inputCols=used, outputCol="raw").transform(filled)
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors).select(key, "scaled").persist()
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster", initSteps=5, maxIter=50).fit(scaled)
    scaled.unpersist()
    labels = F.array(*[F.lit(n) for n in name_clusters([list(map(float, c)) for c in model.clusterCenters()], used)])
    return model.transform(scaled).select(key, "cluster", F.get(labels, F.col("cluster")).alias("label"))


# Corridors and slices


def between_zones(od: DataFrame, weekend: bool | None = None) -> DataFrame:
    kept = od.where("origin <> dest")
    return kept if weekend is None else kept.where(F.col("is_weekend") == weekend)


def corridors(od: DataFrame, top: int, weekend: bool | None = None) -> DataFrame:
    """The busiest pairs of different zones in trips a day, over the days that have any (ties: by code)."""
    kept = between_zones(od, weekend)
    days = kept.agg(F.greatest(F.countDistinct("day"), F.lit(1)).alias("days"))
    pairs = kept.groupBy("origin", "dest").agg(F.sum("trips").alias("trips")).join(F.broadcast(days))  # one row
    per_day = pairs.select("origin", "dest", (F.col("trips") / F.col("days")).alias("trips_day"))
    return per_day.orderBy(F.desc("trips_day"), "origin", "dest").limit(top)


def arcs(pairs: DataFrame, centroids: DataFrame) -> DataFrame:
    """Corridors with both ends' coordinates; pairs with an end that isn't known go."""
    end = lambda s: centroids.select(F.col("zone").alias(f"{s}_zone"), F.round("lon", 5).alias(f"{s}_lon"), F.round("lat", 5).alias(f"{s}_lat"))
    out = pairs.join(end("o"), F.col("origin") == F.col("o_zone")).join(end("d"), F.col("dest") == F.col("d_zone"))
    return out.select("origin", "dest", "o_lon", "o_lat", "d_lon", "d_lat", F.round("trips_day", 1).alias("value"))


def slices(od: DataFrame, top: int = 8000) -> DataFrame:
    """(window, day_type, origin, dest, trips_day, hourly): each season's busiest corridors by day type.

    Values are per day of the slice; ``hourly`` has 24 of them.
    """
    kept = between_zones(od).where("season is not null").withColumn("day_type", F.when(F.col("is_weekend"), "weekend").otherwise("weekday"))
    key = ["season", "day_type"]
    days = kept.groupBy(*key).agg(F.countDistinct("day").alias("days"))
    hours = [sum_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    pairs = kept.groupBy(*key, "origin", "dest").agg(F.sum("trips").alias("trips"), *hours).join(days, key)
    best = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("trips"), "origin", "dest"))
    vector = F.array(*[F.round(F.col(f"h{h}") / F.col("days"), 2) for h in range(24)])
    return pairs.withColumn("r", best).where(F.col("r") <= top).select(*key, "origin", "dest", F.round(F.col("trips") / F.col("days"), 2).alias("trips_day"), vector.alias("hourly"))


def slice_locations(sliced: DataFrame) -> DataFrame:
    """Zones that any slice refers to."""
    return sliced.select(F.col("origin").alias("zone")).union(sliced.select("dest")).distinct()


def at_hour(sliced: DataFrame, hour: int) -> DataFrame:
    """A slice with its flows of one hour; where there is no hourly vector, the whole day's."""
    return sliced.withColumn("count", F.coalesce(F.get("hourly", F.lit(hour)), F.col("trips_day")))


def location_totals(flows: DataFrame) -> DataFrame:
    """Trips that leave, reach and stay in each zone."""
    ends = flows.select(F.inline(F.array(
        F.struct(F.col("origin").alias("zone"), F.when(F.col("origin") != F.col("dest"), F.col("trips")).alias("leaving"), F.lit(None).cast("double").alias("reaching"), F.when(F.col("origin") == F.col("dest"), F.col("trips")).alias("staying")),
        F.struct(F.col("dest").alias("zone"), F.lit(None).cast("double").alias("leaving"), F.when(F.col("origin") != F.col("dest"), F.col("trips")).alias("reaching"), F.lit(None).cast("double").alias("staying")),
    )))
    return ends.groupBy("zone").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("leaving", "reaching", "staying")])


def parent_flows(flows: DataFrame, parent: Column = None) -> DataFrame:
    """Flows between zones' parents (by default the two-character province): the zoomed-out view."""
    up = lambda c: F.substring(c, 1, 2) if parent is None else parent(F.col(c))
    return flows.groupBy(up("origin").alias("from_parent"), up("dest").alias("to_parent")).agg(F.sum("trips").alias("trips"))


def domains(frame: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value; [0, 1] if there is none, and one more at the top if they are equal."""
    ends = frame.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    return ends.select(*by, lo.alias("lo"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("hi"))
