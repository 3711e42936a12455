"""Timetables: active services, and how often a stop is served, in all and on trips to the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the core stations' names, in lower case.
CORE = (
    "barcelona-sants", "barcelona sants", "passeig de gràcia", "passeig de gracia", "barcelona-passeig", "catalunya",
    "plaça d'espanya", "plaça espanya", "plaza espanya", "estació de frança", "estacio de franca",
)
BOX = (0.0, 4.0, 40.5, 42.9)
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def active_services(calendar: DataFrame | None, calendar_dates: DataFrame | None, weekday: int) -> DataFrame:
    """(service_id) of services that run on a weekday (0 is Monday).

    By the calendar's flag, where there is a calendar.  Without one, those of the added date with most
    rows (ties: the first) among the dates of that weekday, or among all dates if none is of it.
    """
    if calendar is not None:
        return calendar.where(F.col(DAYS[weekday]).cast("string") == "1").select("service_id").distinct()
    added = calendar_dates.where(F.col("exception_type").cast("string") == "1").withColumn("on", F.try_to_date("date", "yyyyMMdd")).where("on is not null")
    counts = added.groupBy("date", "on").agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct((F.weekday("on") == weekday).alias("fits"), "n", (-F.datediff("on", F.lit("1970-01-01"))).alias("back"), "date")).alias("b")).select("b.date")
    return added.join(F.broadcast(best), "date").select("service_id").distinct()  # one row


def core_stops(stops: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for part in CORE:
        hit = hit | F.contains(F.lower("stop_name"), F.lit(part))
    return stops.where(hit).select("stop_id").distinct()


def frequency(stops: DataFrame, trips: DataFrame, stop_times: DataFrame, services: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """(stop_id, trips_per_day, trips_to_bcn_core): distinct trips of active services by stop; 0 if none."""
    active = trips.join(services, "service_id", "left_semi").select("trip_id")
    calls = stop_times.select("trip_id", "stop_id").join(active, "trip_id", "left_semi").distinct()
    to_core = calls.join(core if core is not None else core_stops(stops), "stop_id", "left_semi").select(F.col("trip_id").alias("core_trip")).distinct()
    marked = calls.join(to_core, F.col("trip_id") == F.col("core_trip"), "left")
    counts = marked.groupBy("stop_id").agg(F.count("trip_id").alias("trips_per_day"), F.count("core_trip").alias("trips_to_bcn_core"))
    return stops.select("stop_id").distinct().join(counts, "stop_id", "left").na.fill(0, ["trips_per_day", "trips_to_bcn_core"])
