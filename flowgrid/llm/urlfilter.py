"""URL filters by a temporal list join, in DataFrame expressions alone.

A list is a table of dated events (kind, pattern, action add or remove, day, category).  A pattern's
events become validity intervals, category by category: from an add up to the next event of the same
kind, pattern and category; a removal without a category ends all categories of its pattern.
A capture (url, day fetched) is looked up under each key that a list may name it by: its host and the
host's parent domains, and its host with each leading path directory.  The as-of join asks,
for each key, for the one interval that holds on the capture's day.

Captures go through the join as (key, day), each distinct pair once, so that a host with a third of
all captures takes part with at most one row a day; the answers come back to the captures by an
equi-join on (host, directory, day) that may be split where it is skewed.

Cases: a null or empty url, or one without a host, has no keys and is not blocked; a null day isn't
blocked either.  Intervals hold from their first day on and up to the day before their last; of events
of one pattern and category on one day, the removal counts; of several entries that hold, the longest
pattern, then the greatest kind, pattern and category is named.  Hosts compare in lower case without user or port.
Repeated rows get equal results; an empty table or list gives none; a path of n directories has n keys,
each as long as its part of the path.  Other columns pass through, but for blocked, category, list_kind
and list_pattern, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, category, start, end): a pattern is listed from start up to the day before end."""
    gone = F.col("action") == "remove"
    named = events.where(~gone | F.col("category").isNotNull()).select("kind", "pattern", "category", "day", gone.alias("gone"))
    known = named.where(~F.col("gone")).select("kind", "pattern", "category").distinct()
    of = lambda c: F.col(f"e.{c}") == F.col(f"k.{c}")
    every = events.where(gone & F.col("category").isNull()).alias("e").join(known.alias("k"), of("kind") & of("pattern")).select("k.kind", "k.pattern", "k.category", "e.day", F.lit(True).alias("gone"))
    daily = named.unionByName(every).groupBy("kind", "pattern", "category", "day").agg(F.max("gone").alias("gone"))
    later = F.lead("day").over(W.partitionBy("kind", "pattern", "category").orderBy("day"))
    spans = daily.withColumn("end", later).where(~F.col("gone"))
    return spans.select("kind", "pattern", "category", F.col("day").alias("start"), "end")


def list_keys(host: Column, path: Column) -> Column:
    """array<struct<kind, pattern>>: the names under which a list may have a capture of this host and path."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    domain = lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, size - i + 1), ".").alias("pattern"))
    parts = F.split(path, "/")
    depth = F.size(parts) - 1  # directories, with the root
    prefix = lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")).alias("pattern"))
    none = F.expr("cast(array() as array<struct<kind:string,pattern:string>>)")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), domain)
    prefixes = F.when(depth >= 1, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), prefix)).otherwise(none)
    return F.when(host != "", F.concat(domains, prefixes)).otherwise(none)


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (url, day, ...) with blocked, category (the first by name), list_kind and list_pattern (the longest that holds)."""
    names = [c for c in captures.columns if c not in ("blocked", "category", "list_kind", "list_pattern")]
    directory = F.regexp_extract(path_of(F.col("url")), "^(.*/)", 1)
    marked = captures.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(directory, F.lit("")).alias("dir"), F.col("day").alias("at")
    )
    asked = marked.select("host", "dir", "at").where("host <> '' and at is not null").distinct()
    keyed = asked.select("host", "dir", "at", F.inline(list_keys(F.col("host"), F.col("dir"))))
    valid = intervals(events).withColumnRenamed("kind", "l_kind").withColumnRenamed("pattern", "l_pattern")
    holds = (F.col("kind") == F.col("l_kind")) & (F.col("pattern") == F.col("l_pattern")) & (F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    hit = F.struct(F.length("pattern").alias("n"), "kind", "pattern", "category")
    answers = keyed.join(valid, holds).groupBy(F.col("host").alias("h"), F.col("dir").alias("d"), F.col("at").alias("t")).agg(F.max(hit).alias("hit"))
    found = marked.join(answers, (F.col("host") == F.col("h")) & (F.col("dir") == F.col("d")) & (F.col("at") == F.col("t")), "left")
    return found.select(
        "row.*", F.col("hit").isNotNull().alias("blocked"), F.col("hit.category").alias("category"), F.col("hit.kind").alias("list_kind"), F.col("hit.pattern").alias("list_pattern")
    )
