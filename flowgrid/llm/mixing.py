"""Mixing sources to target weights by a time-varying curriculum, in DataFrame expressions alone.

Targets: the words of all documents are shared among the sources by weight; what exceeds a source's
cap (so many times its size) is shared again by weight until no target is above its cap.  With the
sources in order of cap by weight, the capped ones are the first few, which one window over the
sources finds in closed form.

Takings: a source's documents form one stream in the order of a hash of doc_id.  The stream is gone
through as often as the target has whole passes, and once more up to the target's last word.  Places
in the stream are cumulative sums in two steps, over hash ranges of about ``rows_per_range`` documents
and within each, so no task gathers a source.

Positions: each source's weight changes over the training run by a linear ramp (its schedule, whose
integral is its share).  A copy's position is where the source's integrated demand reaches the copy's
place in the stream: the inverse of a quadratic.  The result can be range-sorted by it; around each
position the sources then stand in the ratio of their ramps there.

Cases: null text has size 0, documents of size 0 are never taken; null source is a source, last in
order; a null doc_id is ordered by a hash of its text; rows that share a doc_id are ordered by that
hash; rows that are repeated in full share one order key, so that which of them is taken is not
defined, but the result as a bag of rows is; a very long text is only counted; an empty table gives
no rows; other columns are ignored by ``mix`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgrid.llm.common import checkpointed, n_words

#: Weights by the source's place among the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: Slopes of the linear ramps by the same place: the weight at run's start is 1 - slope/2 of its mean.
SLOPES = (0.0, 1.0, -1.0)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) with weight, slope and target.

    One row a source: the windows here are over sources, not documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), place % len(xs))
    named = sizes.select("source", "source_size", pick(weights).cast("long").alias("weight"), pick(SLOPES).alias("slope"))
    cap = F.col("source_size") * max_repeats
    by_ratio = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = named.select("*", (left / F.sum("weight").over(from_here)).alias("level"), cap.alias("cap"))
    # A source whose level reaches its cap is capped; the first that isn't sets the level of all behind it.
    free = F.col("level") * F.col("weight") < F.col("cap")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, 0))
    return share.select("source", "source_size", "weight", "slope", F.coalesce(level * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def order_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), text_hash(text).cast("string")).cast("binary"))


def taken(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, rows_per_range: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken, and place (words before it in its source's stream), slope, source.

    Sizes are counted once and written to the checkpoint folder; texts aren't shuffled.
    """
    sized = checkpointed(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"), text_hash(F.col("text")).alias("text_hash"))
    )
    # A range is a stretch of the key's first 28 bits; as many as the table's length asks for.
    n = sized.count()
    ranges = max(1, n // rows_per_range)
    first = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    sized = sized.withColumn("range", F.floor(first * ranges / F.lit(1 << 28)).cast("long"))
    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = by_range.withColumn("range_start", before)
    goals = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights=weights, max_repeats=max_repeats)
    starts = starts.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("source", "range_size").withColumnRenamed("range", "r")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    words = F.floor("target").cast("long")
    safe = F.greatest(F.col("source_size"), F.lit(1))
    passes = F.floor(words / safe).cast("long")
    rest = F.least(F.greatest(words - passes * F.col("source_size") - F.col("place"), F.lit(0)), F.col("size"))
    return both.withColumn("place", F.col("range_start") + F.col("inside")).select(
        "doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + rest).cast("long").alias("taken"),
        "place", passes.alias("passes"), rest.cast("long").alias("rest"), "slope", "text_hash",
    )


def position(pass_number: Column) -> Column:
    """Where in the run (0 to 1) a source's integrated demand reaches a document's copy in that pass.

    With weight 1 + slope * (t - 1/2), demand by time t is t * (1 - slope/2) + slope/2 * t^2 of the target.
    """
    c = (pass_number * F.col("source_size") + F.col("place")) / F.greatest(F.col("target"), F.lit(1.0))
    a, b = F.col("slope") / 2, 1 - F.col("slope") / 2
    root = (F.sqrt(F.greatest(b * b + 4 * a * c, F.lit(0.0))) - b) / F.when(a != 0, 2 * a)
    return F.least(F.greatest(F.coalesce(root, c), F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The op's result: what the mix takes of each document and where its first copy stands, range-sorted by that."""
    out = taken(docs, **options).withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0))))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each copy taken, range-sorted by training position.

    The last copy of a source may be cut off by the target; it stays whole if at least half its words
    are within.  Documents that the mix doesn't take (all without words, and those behind the target) go.
    Rows are joined by doc_id, source and a hash of the text; those that are equal in these are numbered
    by a hash of all their columns, so that reruns agree.
    """
    names = docs.columns
    plan = taken(docs, **options).withColumn("copies", F.col("passes") + (2 * F.col("rest") >= F.greatest(F.col("size"), F.lit(1))).cast("long"))
    plan = plan.where("copies > 0 and size > 0").select(
        F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), F.col("source").alias("__mix_source"), "copies", "place", "source_size", "target", "slope"
    )
    key = ["__mix_id", "__mix_hash", "__mix_source"]
    plan = checkpointed(plan.withColumn("__mix_nth", F.row_number().over(W.partitionBy(*key).orderBy("place"))))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__mix_row"),
        F.col("doc_id").alias("__id"), text_hash(F.col("text")).alias("__hash"), F.col("source").cast("string").alias("__source"),
    )
    pairs = F.col("__id").eqNullSafe(F.col("__mix_id")) & (F.col("__hash") == F.col("__mix_hash")) & F.col("__source").eqNullSafe(F.col("__mix_source"))
    if not plan.where("__mix_nth > 1").isEmpty():
        # Repeated rows: they are numbered on both sides, so that each meets one row of the plan.
        marked = marked.withColumn("__nth", F.row_number().over(W.partitionBy("__id", "__hash", "__source").orderBy(F.xxhash64("__mix_row"))))
        pairs = pairs & (F.col("__nth") == F.col("__mix_nth"))
    copies = marked.join(plan, pairs).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    placed = copies.select("__mix_row", "__id", position(F.col("__copy")).alias("__at"))
    return placed.repartitionByRange("__at", "__id").sortWithinPartitions("__at", "__id").select("__mix_row.*")


