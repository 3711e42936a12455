"""Descriptive statistics of cubes and of wide cell tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def weekday_name(day: Column) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(F.to_date(day, "yyyyMMdd")))


def with_weekday(frame: DataFrame) -> DataFrame:
    date = F.to_date("day", "yyyyMMdd")
    return frame.withColumns({"weekday_name": weekday_name(F.col("day")), "is_weekend": F.weekday(date) >= 5, "month": F.date_format(date, "yyyy-MM")})


def weekday_frame(spark: SparkSession) -> DataFrame:
    """(weekday_name, n): the fixed order of the days, for rows that must be there even without data."""
    return spark.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)], "weekday_name string, n int")


def weekday_totals(frame: DataFrame) -> DataFrame:
    """Mean daily total of each weekday; null for one without data."""
    daily = with_weekday(frame).groupBy("day", "weekday_name").agg(F.sum("trips").alias("t"))
    means = daily.groupBy("weekday_name").agg(F.avg("t").alias("mean_trips"))
    return F.broadcast(weekday_frame(frame.sparkSession)).join(means, "weekday_name", "left").select("n", "weekday_name", "mean_trips")


def hourly_profile(frame: DataFrame) -> DataFrame:
    """Totals by weekday (rows) and hour (columns h0 to h23), 0 where there are none."""
    hours = [F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("trips"))), F.lit(0.0)).alias(f"h{h}") for h in range(24)]
    grid = with_weekday(frame).groupBy("weekday_name").agg(*hours)
    return F.broadcast(weekday_frame(frame.sparkSession)).join(grid, "weekday_name", "left").na.fill(0.0)


def corridor_peaks(frame: DataFrame) -> DataFrame:
    """All pairs of zones with their total and their busiest hour (ties: the earliest hour)."""
    by_hour = frame.groupBy("origin", "dest", "hour").agg(F.sum("trips").alias("t"))
    return by_hour.groupBy("origin", "dest").agg(F.sum("t").alias("trips"), F.max_by("hour", F.struct("t", -F.col("hour"))).alias("peak_hour"))


def peak_hours(frame: DataFrame, top: int = 20) -> DataFrame:
    """The busiest pairs of zones (ties: by code) and their busiest hour."""
    return corridor_peaks(frame).orderBy(F.desc("trips"), "origin", "dest").limit(top)


def anomalies(frame: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Days whose total lies more than sigma sample deviations from the mean."""
    daily = frame.groupBy("day").agg(F.sum("trips").alias("trips"))
    whole = daily.agg(F.avg("trips").alias("mean"), F.stddev_samp("trips").alias("sd"))
    z = daily.join(F.broadcast(whole)).select("day", "trips", ((F.col("trips") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("z_score"))
    return z.where(F.abs("z_score") > sigma)


def shares_within(frame: DataFrame, group: str, label: str, value: str = "trips") -> DataFrame:
    """Each label's total and its share within the group."""
    sums = frame.groupBy(group, label).agg(F.sum(value).alias(value))
    whole = F.sum(value).over(W.partitionBy(group))
    return sums.withColumn("share", F.col(value) / F.when(whole > 0, whole))


def cross_totals(frame: DataFrame, rows: str, columns: str, labels: Sequence[str], value: str = "trips") -> DataFrame:
    """Totals by two labels, the second as columns, 0 where there are none."""
    return frame.groupBy(rows).pivot(columns, list(labels)).agg(F.sum(value)).na.fill(0.0)


def province_weekdays(frame: DataFrame) -> DataFrame:
    """Mean over (day, origin) totals by the origin's province and weekday."""
    daily = with_weekday(frame).groupBy("day", "weekday_name", "origin").agg(F.sum("trips").alias("t"))
    return daily.groupBy(F.substring("origin", 1, 2).alias("province")).pivot("weekday_name", list(WEEKDAYS)).agg(F.avg("t"))


def daily_series(frame: DataFrame) -> DataFrame:
    return frame.groupBy("day").agg(F.sum("trips").alias("trips")).orderBy("day")


def histogram_of_hours(frame: DataFrame, hour: str) -> DataFrame:
    """Counts for all 24 hours."""
    counts = frame.groupBy(F.col(hour).alias("hour")).agg(F.count("*").alias("n"))
    slots = frame.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return slots.join(counts, "hour", "left").na.fill(0, ["n"])


def coverage(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with a value, by column, in one pass."""
    known = frame.agg(*[F.round(F.avg(F.col(c).isNotNull().cast("int")), 4).alias(c) for c in columns])
    return known.unpivot([], list(columns), "feature", "coverage")


STATISTICS = ("min", "p25", "p50", "p75", "max", "mean", "std")


def describe(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, quartiles (interpolated), max, mean and sample deviation, a row for each column."""

    def of(c: str) -> Column:
        q = lambda p: F.percentile(c, F.lit(p))
        values = (F.min(c), q(0.25), q(0.5), q(0.75), F.max(c), F.avg(c), F.stddev_samp(c))
        return F.struct(F.lit(c).alias("feature"), *[v.cast("double").alias(s) for s, v in zip(STATISTICS, values, strict=True)])

    return frame.agg(F.array(*map(of, columns)).alias("rows")).select(F.inline("rows"))


def label_counts(frame: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Counts by label: the given ones first and in order (0 if absent), then any others by name."""
    counts = frame.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    fixed = frame.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], "label string, place int")
    both = F.broadcast(fixed).join(counts, "label", "full")
    return both.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(order))).alias("place")).orderBy("place", "label")


def regression(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """How a column changed between two tables: medians, correlation, median relative change, distinct values."""
    pairs = old.select(key, *[F.col(c).alias(f"{c}_old") for c in columns]).join(new.select(key, *[F.col(c).alias(f"{c}_new") for c in columns]), key)

    def of(c: str) -> Column:
        a, b = F.col(f"{c}_old"), F.col(f"{c}_new")
        change = F.abs(b - a) / F.when(a != 0, F.abs(a))
        return F.struct(
            F.lit(c).alias("feature"), F.count("*").alias("n"), F.percentile(a, F.lit(0.5)).alias("median_old"), F.percentile(b, F.lit(0.5)).alias("median_new"),
            F.corr(a, b).alias("correlation"), F.percentile(change, F.lit(0.5)).alias("median_change"), F.countDistinct(b).alias("distinct_new"),
        )

    return pairs.agg(F.array(*map(of, columns)).alias("rows")).select(F.inline("rows"))


def season_days(od: DataFrame) -> DataFrame:
    """Days by season against the calendar's number, summed over the years there are; complete if every year is."""
    want = F.when(F.col("season") == "feb", 28).when(F.col("season") == "may", 31).otherwise(30).cast("long")
    per_year = od.where("season is not null").groupBy("season", F.substring("day", 1, 4).alias("year")).agg(F.countDistinct("day").alias("days")).withColumn("want", want)
    return per_year.groupBy("season").agg(F.sum("days").alias("days"), F.sum("want").alias("expected"), F.bool_and(F.col("days") >= F.col("want")).alias("complete"))
