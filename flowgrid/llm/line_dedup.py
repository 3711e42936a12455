"""Line dedup on chunks of neighbouring lines.

A rolling hash over two line hashes stands at every line but the last.  Where it occurs more than once
in the corpus, its first place (by doc_id, a hash of the row, and line) is looked up.  A chunk is as
many lines as follow one first place line by line, so that its ends depend on nothing but what is
repeated; boundaries picked by a rolling hash alone would cut off both ends of every repeated passage,
and lose the short ones altogether.  A chunk has two lines or more and a word in each pair of them.
Its bytes are compared with those of its first place, and its lines go if they are equal.  A pair
that shares a line with its own first place stays.

Pairs are counted with partial sums.  Texts aren't shuffled, but for those of first places and those
that lose lines: fixed-size bitmaps of the rows wanted (at most MOST_BITMAPS of 4 KB, broadcast) pick
them out; what the bitmaps let through too much doesn't matter.  The text of a first place goes to its
copies by up to SALTS ways, so that thousands of copies of one document don't meet in one task.

Cases: null text stays null, documents of one line stay as they are, and a null doc_id isn't looked
at.  Rows that share a doc_id but not a text are documents of their own; rows equal in both are one
document, whose rows lose the same lines.  A document whose lines all go is left with an empty text.
A long text is held by one task at a time, once for itself and once for what it is compared with.
An empty table gives no rows; other columns pass through, but for n_lines and n_removed, which dedup
replaces and cut keeps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.common import checkpointed

_U64 = np.uint64
#: Odd factors of the two rolling hashes.
_FACTORS = np.random.default_rng(77).integers(0, 1 << 63, 6, dtype=np.uint64) * _U64(2) + _U64(1)
BITMAP_BITS, MOST_BITMAPS = 32768, 4096
SALTS = 64


def rolled(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rolling hashes of all pairs of neighbouring lines, from their line hashes."""
    out = []
    for k in (0, 3):
        x = hashes[:-1] * _FACTORS[k] + (hashes[1:] ^ (hashes[1:] >> _U64(31))) * _FACTORS[k + 1]
        x ^= x >> _U64(29)
        x *= _FACTORS[k + 2]
        out.append((x ^ (x >> _U64(32))).view(np.int64))
    return out[0], out[1]


def row_key() -> Column:
    """A hash of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, first, h1, h2) of every pair of neighbouring lines with a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                lines = text.as_py().split(b"\n")
                if len(lines) < 2:
                    continue
                worded = np.fromiter((bool(x.strip()) for x in lines), bool, len(lines))
                at = (worded[1:] | worded[:-1]).nonzero()[0]
                h1, h2 = rolled(np.fromiter(map(xxhash.xxh3_64_intdigest, lines), _U64, len(lines)))
                for part, x in zip(parts, (np.full(len(at), doc), np.full(len(at), row), at.astype(np.int32), h1[at], h2[at]), strict=True):
                    part.append(x)
            types = (np.int64, np.int64, np.int32, np.int64, np.int64)
            cols = [pa.array(np.concatenate(p) if p else np.zeros(0, t)) for p, t in zip(parts, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "first", "h1", "h2"])

    read = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, row long, first int, h1 long, h2 long")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, from_id, from_row, shift, lines): lines repeated from a first place, by the place's line numbers, shift lines lower."""
    every = checkpointed(pairs(docs))
    place = F.struct("doc_id", "row", "first")
    heads = every.groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.count("*").alias("n"), F.min(place).alias("head")).where("n > 1")
    same_row = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("row") == F.col("head.row"))
    own = same_row & (F.col("first") - F.col("head.first")).isin(0, 1)  # the first place itself, or sharing a line with it
    marked = every.join(heads, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(~own)
    shift = (F.col("first") - F.col("head.first")).alias("shift")
    along = marked.groupBy("doc_id", "row", F.col("head.doc_id").alias("from_id"), F.col("head.row").alias("from_row"), shift).agg(F.collect_set("head.first").alias("at"))
    both = F.flatten(F.transform("at", lambda x: F.array(x, x + 1)))
    return along.select("doc_id", "row", "from_id", "from_row", "shift", F.array_sort(F.array_distinct(both)).alias("lines"))


def _place(key: Column, bitmaps: int) -> tuple[Column, Column]:
    """Number of a key's bitmap, and its bit there."""
    spread = F.pmod(F.xxhash64(key), F.lit(bitmaps * BITMAP_BITS))
    return F.floor(spread / BITMAP_BITS).cast("long"), F.pmod(spread, F.lit(BITMAP_BITS)).cast("long")


def picked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with __wanted: false only where the row's key isn't among keys (key)."""
    found = keys.distinct()
    bitmaps = min(MOST_BITMAPS, max(1, -(-found.count() * 16 // BITMAP_BITS)))
    number, bit = _place(F.col("key"), bitmaps)
    maps = found.groupBy(number.alias("__number")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    number, bit = _place(row_key(), bitmaps)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
    out = docs.join(F.broadcast(maps), number == F.col("__number"), "left")  # at most MOST_BITMAPS rows of 4 KB
    return out.withColumn("__wanted", F.coalesce(hit, F.lit(False))).drop("__number", "__bits")


def cut(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_removed): docs' own columns, the shortened text, and lines before and taken out."""
    found = checkpointed(chunks(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int")))
    # The first places' lines, from the least to the last one asked for.
    wanted = found.groupBy("from_id", "from_row", "salt").agg(F.min(F.get("lines", F.lit(0))).alias("low"), F.max(F.element_at("lines", -1)).alias("high"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sources = picked(plain, found.select(F.col("from_row").alias("key"))).where("__wanted").select("doc_id", row_key().alias("source"), "text").dropDuplicates(["doc_id", "source"])
    bodies = sources.join(wanted, (F.col("doc_id") == F.col("from_id")) & (F.col("source") == F.col("from_row"))).select(
        F.col("from_id").alias("s_id"), F.col("from_row").alias("s_row"), F.col("salt").alias("s_salt"), "low",
        F.slice(F.split("text", "\n"), F.col("low") + 1, F.col("high") - F.col("low") + 1).alias("body"),
    )
    sent = found.join(bodies, (F.col("from_id") == F.col("s_id")) & (F.col("from_row") == F.col("s_row")) & (F.col("salt") == F.col("s_salt")))
    expected = F.transform("lines", lambda x: F.struct((x + F.col("shift")).alias("line"), F.get("body", x - F.col("low")).alias("want")))
    gone = sent.groupBy(F.col("doc_id").alias("__gone_id"), F.col("row").alias("__gone_row")).agg(F.collect_list(expected).alias("__gone"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = picked(docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), found.select(F.col("row").alias("key")))
    n_lines = F.when(F.col("text").isNotNull(), F.length("text") - F.length(F.translate("text", "\n", "")) + 1).otherwise(0).alias("n_lines")
    intact = both.where(~F.col("__wanted")).select("row", "text", n_lines, F.lit(0).alias("n_removed"))
    key = row_key()
    touched = both.where("__wanted").join(gone, (F.col("doc_id") == F.col("__gone_id")) & (key == F.col("__gone_row")), "left")
    # A line goes if it reads as expected, and so does a neighbour of it in the same chunk.
    lines = F.split("text", "\n")

    def verified(own: Column, chunk: Column) -> Column:
        equal = F.transform(chunk, lambda x: F.struct(x["line"].alias("line"), (F.get(own, x["line"]) == x["want"]).alias("same")))
        beside = lambda y, x, d: F.coalesce(y["same"] & (y["line"] == x["line"] + d), F.lit(False))
        goes = lambda e: F.filter(e, lambda x, k: x["same"] & (beside(F.get(e, k - 1), x, -1) | beside(F.get(e, k + 1), x, 1)))
        return F.transform(F.get(F.transform(F.array(equal), goes), F.lit(0)), lambda x: x["line"])

    def shortened(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.flatten(F.transform("__gone", lambda c: verified(own, c))))
        return F.get(F.transform(F.array(stay), lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(own, i)), "\n").alias("text"), (F.size(own) - F.size(s)).alias("n"))), F.lit(0))

    left = F.get(F.transform(F.array(lines), shortened), F.lit(0))  # the lines are made once
    some = F.col("__gone").isNotNull() & F.col("text").isNotNull()
    worked = touched.select("row", "text", n_lines, F.when(some, left).alias("__left"))
    unchanged = F.col("__left").isNull() | (F.col("__left.n") == 0)
    return intact.unionByName(
        worked.select("row", F.when(unchanged, F.col("text")).otherwise(F.col("__left.text")).alias("text"), "n_lines", F.coalesce("__left.n", F.lit(0)).alias("n_removed"))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with their texts shortened, and n_lines and n_removed (lines before, lines taken out)."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut(docs).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in kept], "n_lines", "n_removed")
