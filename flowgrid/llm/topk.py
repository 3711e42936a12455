"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length into buckets of about BUCKET rows (bucket bounds are quantiles of the
length, LEAST_PARTS of them at least; a bucket that ties make larger is split by a hash).  Queries of
like length form blocks.  First each query
meets the bucket of the longest vectors, which gives a lower bound of its k-th score.  A bucket whose
longest vector times the block's longest query can't reach the least bound of the block is left out;
the others meet the block.  There each query has a local threshold on the cosine, its bound divided by
its own and the bucket's greatest length: above 1 nothing can qualify; below COORDINATE it cuts the
bucket by length, above by the range that the query's largest coordinates leave to a vector at that
cosine (widened a little against rounding).  Exact integer products of what is left are taken.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part, as queries
or as candidates; vectors of another dimension than the query's are no candidates.  Ties go to the
smaller id.  Rows that share an id are all candidates, and a query row is met by every other row's id
but its own; a query id that occurs in several rows is answered once, for the least of its vectors
(component by component).  Scores are 64-bit integers: where the square of the largest quantized
component, times the dimension, reaches 2^63 (components of
1.4 million at 64 dimensions and a scale of 256), a ValueError is raised, so that nothing wraps around.
Fewer candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgrid.llm.common import checkpointed

BUCKET, BLOCK = 4096, 256
#: Least and most length classes; a class of more rows than two buckets is split by a hash.
LEAST_PARTS, MAX_PARTS = 16, 2048
#: Ways by which the first bucket goes to the blocks.
SALTS = 16
COORDINATE = 0.6
FOCUS = 3


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, dim, norm, v): floor(scale * x) of the components of usable vectors; what no 64-bit integer can hold is kept at 2^62."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    most = float(1 << 62)
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))), F.lit(1 << 62)), F.lit(-(1 << 62))).cast("long"))
    read = vectors.select(F.col("vec_id").cast("long").alias("id"), F.when(fine, v).alias("v")).where("id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    return read.select("id", F.size("v").alias("dim"), norm.alias("norm"), "v")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key: dim, longest norm, ids and matrix, ids in descending norm."""
    entry = F.struct((-F.col("norm")).alias("down"), "id", "v")
    packed = rows.groupBy(key, "dim").agg(F.max("norm").alias("longest"), F.sort_array(F.collect_list(entry)).alias("rows"))
    return packed.select(key, "dim", "longest", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def _candidates(q: np.ndarray, length: float, norms: np.ndarray, unit: np.ndarray, bound: float) -> np.ndarray | None:
    """Rows of a bucket (descending norms) that can reach the bound; None for all."""
    if bound <= 0 or length == 0:
        return None
    threshold = bound / (length * norms[0]) if norms[0] else 2.0
    if threshold > 1 + 1e-9:
        return np.zeros(0, np.int64)
    n = int(np.searchsorted(-norms, -(bound / length) * (1 - 1e-9), side="right"))  # by length
    rows = np.arange(n)
    if threshold >= COORDINATE:
        unit_q = q / length
        t = min(threshold, 1.0)
        for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
            # A vector within arccos(t) of the query is within that angle of the query's angle to the axis.
            spread = np.sqrt(max(0.0, (1 - unit_q[f] ** 2) * (1 - t * t)))
            low = -1.0 if unit_q[f] < -t else unit_q[f] * t - spread
            high = 1.0 if unit_q[f] > t else unit_q[f] * t + spread
            x = unit[rows, f]
            rows = rows[(x >= low - 1e-6) & (x <= high + 1e-6)]
    return rows


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every block of queries in the bucket beside it: (query_id, vec_id, score)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                dim = row["dim"].as_py()
                array = lambda c: row[c].values.to_numpy(zero_copy_only=False)
                q_ids, ids = array("q_ids"), array("ids")
                q, v = array("q_flat").reshape(-1, dim), array("flat").reshape(-1, dim)
                bounds = array("bounds")
                exact = float(np.abs(q).max()) * float(np.abs(v).max()) * dim < 2**53
                as_real, q_real = v.astype(float), q.astype(float)
                norms, lengths = np.sqrt((as_real**2).sum(1)), np.sqrt((q_real**2).sum(1))
                unit = as_real / np.where(norms > 0, norms, 1)[:, None]
                out: list[np.ndarray] = []
                for i in range(len(q)):
                    rows = _candidates(q_real[i], lengths[i], norms, unit, bounds[i])
                    if rows is None:
                        score = as_real @ q_real[i] if exact else v @ q[i]
                        rows = np.arange(len(v))
                    else:
                        score = as_real[rows] @ q_real[i] if exact else v[rows] @ q[i]
                    other = ids[rows] != q_ids[i]
                    rows, score = rows[other], score[other].astype(np.int64)
                    if len(rows) > k:  # all that tie with the k-th, then the smallest ids of those
                        rows, score = (x[score >= np.partition(score, -k)[-k]] for x in (rows, score))
                    best = np.lexsort((ids[rows], -score))[:k]
                    out.append(np.stack([np.full(len(best), q_ids[i]), ids[rows[best]], score[best]], 1))
                found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in range(3)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, *, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows."""
    v = checkpointed(quantized(vectors, scale))
    largest = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    total, most, dims = v.agg(F.count("*"), F.coalesce(largest, F.lit(0)), F.coalesce(F.max("dim"), F.lit(0))).first()
    if most * most * dims >= 1 << 63:
        raise ValueError(f"components up to {most} / {scale} in {dims} dimensions: their products don't fit 64-bit scores")
    n = min(MAX_PARTS, max(LEAST_PARTS, -(-total // BUCKET)))
    cuts = v.approxQuantile("norm", [i / n for i in range(1, n)], 1 / (4 * n)) if total else []
    longer = F.lit(0)  # number of cuts at or above the norm: 0 is the bucket of the longest
    if cuts:
        longer = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c > F.col("norm")))
    placed = v.withColumn("part", longer.cast("long"))
    sizes = placed.groupBy(F.col("part").alias("p"), F.col("dim").alias("d")).agg(F.count("*").alias("n"))
    split = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (2 * BUCKET)))
    placed = placed.join(sizes, (F.col("part") == F.col("p")) & (F.col("dim") == F.col("d")))  # one row a length class and dimension
    buckets = checkpointed(_blocks(placed.withColumn("bucket", F.col("part") * (1 << 32) + split), "bucket"))
    # Queries of like length share a block; a length that many share is split by a hash.
    one = F.min(F.struct("v", "dim", "norm")).alias("one")
    asked = checkpointed(v.where(is_query(F.col("id"))).groupBy("id").agg(one).select("id", "one.*"))
    n_asked = asked.count()
    m = min(MAX_PARTS, -(-n_asked // BLOCK))
    q_cuts = asked.approxQuantile("norm", [i / m for i in range(1, m)], 1 / (4 * m)) if m > 1 else []
    q_part = F.size(F.filter(F.array(*map(F.lit, sorted(set(q_cuts)))), lambda c: c > F.col("norm"))) if q_cuts else F.lit(0)
    asked = asked.withColumn("part", q_part.cast("long"))
    per = asked.groupBy(F.col("part").alias("qp")).agg(F.count("*").alias("qn"))
    asked = asked.join(per, F.col("part") == F.col("qp"))
    block = F.col("part") * (1 << 32) + F.pmod(F.xxhash64("id"), F.ceil(F.col("qn") / (2 * BLOCK)))
    queries = checkpointed(_blocks(asked.withColumn("block", block), "block"))
    q = queries.select("block", F.col("dim").alias("q_dim"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    none = F.transform("q_ids", lambda _: F.lit(0).cast("long"))
    top = buckets.groupBy(F.col("dim").alias("t_dim")).agg(F.max(F.struct("longest", "bucket")).alias("t"))
    first = buckets.join(top, (F.col("dim") == F.col("t_dim")) & (F.col("bucket") == F.col("t.bucket"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    heads = q.join(first, (F.col("q_dim") == F.col("dim")) & (F.pmod(F.xxhash64("block"), F.lit(SALTS)) == F.col("salt")))
    columns = ["block", "q_ids", "q_flat", "bounds", "dim", "ids", "flat"]
    head = checkpointed(_meet(heads.withColumn("bounds", none).select(*columns), k))
    # The k-th best so far bounds each query; fewer than k found give no bound.
    bounds = _best(head, k).where(F.col("rank") == k).select(F.col("query_id").alias("b_id"), F.col("score").alias("bound"))
    each = q.select("block", "q_dim", F.posexplode("q_ids").alias("at", "one")).join(bounds, F.col("one") == F.col("b_id"), "left")
    known = each.groupBy(F.col("block").alias("k_block"), F.col("q_dim").alias("k_dim")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(0)).alias("bound")))), lambda x: x["bound"]).alias("bounds")
    )
    ready = q.join(known, (F.col("block") == F.col("k_block")) & (F.col("q_dim") == F.col("k_dim")))
    # Each block picks the length classes that can reach its least bound: at most MAX_PARTS for a dimension.
    part = F.shiftright("bucket", 32)
    classes = buckets.groupBy(F.col("dim").alias("m_dim"), part.alias("part")).agg(F.max("longest").alias("longest"))
    meta = classes.groupBy("m_dim").agg(F.collect_list(F.struct("part", "longest")).alias("m"))
    least = F.array_min("bounds")
    reach = F.filter("m", lambda c: (least <= 0) | (c["longest"] * F.col("q_longest") >= least * (1 - 1e-9)))
    wide = ready.join(meta, F.col("q_dim") == F.col("m_dim")).join(top, F.col("q_dim") == F.col("t_dim")).withColumn("want", F.explode(reach["part"]))
    tails = wide.drop("m").join(buckets.withColumn("part", part), (F.col("want") == F.col("part")) & (F.col("q_dim") == F.col("dim"))).where("bucket <> t.bucket")
    found = head.unionByName(_meet(tails.select(*columns), k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
