"""Near duplicates by a chosen-path set similarity join on word shingles.

1. Each text becomes its set of word shingles (64-bit hashes) where it lies; what goes on is the set's
   size, a 128-bit digest, and minwise tokens: for each of ``TREES`` trees and ``LEVELS`` levels the
   least shingle under that level's hash.  A document's path in a tree is the sequence of its tokens.
   Documents of equal sets are one class from here on, represented by the least doc_id.
2. Trees: all documents that share the first DEPTHS[0] tokens form a node.  A pair of similarity s meets
   in a tree with probability s**2, so that TREES independent trees miss a pair of 0.8 with probability
   (1 - 0.8**2)**12 = 5e-6, whatever the nodes' sizes.  Deeper nodes, by which nodes of more than
   NODE_LIMIT documents branch, only serve to find the components of step 3; step 4 takes nodes whole.
3. Nodes are compared exhaustively on sketches (one byte of every minwise token), twice.  First, in
   branched nodes (those still too large at the last depth are dealt out in blocks), the member of a
   node that most others look like meets all of those, then the rest likewise: at most one pair for
   each document and node.  These pairs are verified on the full sets (a leader and up to
   CHUNK partners are shipped to one place), and make components.
4. Then nodes are searched for members that look like a member of another component (MARGIN standard
   errors below the threshold count as alike).  In a node of more than NODE_LIMIT, all members outside
   its largest component meet all members, in pairs of blocks; a node of one component has no work.
   The full sets of these go to their nodes, where all are compared exactly; only links that join
   components are returned.  So a group of n near copies costs about n pairs and n rows a tree.

A link of 0.8 between different groups is missed in all trees with probability 5e-6, and by its sketch
(MARGIN standard errors) with about 1e-6; stronger links by less.

Nothing is collected on the driver; intermediate tables are written to the checkpoint folder.

Cases: null text has no words, and a text without words has an empty set: no links, kept.  Null
doc_id: not linked, component null, kept.  Repeated rows (and rows that share a doc_id) give a row
each, with the component of their doc_id: unequal texts under one doc_id are all searched, and belong
together (doc_ids are below 2^62).  A node's full sets, of up to NODE_LIMIT texts, are held by one
task, so that texts of some 100 MB and more want more memory.  Ties: components go by the least doc_id.  An empty table
gives no rows; other columns are ignored by ``find`` and passed through by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.common import checkpointed, small_batches
from flowgrid.llm.components import components

#: Standard errors below the threshold that still count as alike in a sketch.
MARGIN = 5
#: Where handles of further texts of one doc_id begin.
HANDLES = 1 << 62
TREES, LEVELS = 12, 8
DEPTHS = (2, 4, 8)
NODE_LIMIT = 1024
CHUNK = 64
#: Most words whose hashes a worker keeps, and the longest of them.
_CACHE, _CACHED_BYTES = 200_000, 64
_U64 = np.uint64
#: Odd factors: of the words of a shingle, and of the minwise hashes.
_FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, 16 + TREES * LEVELS, dtype=np.uint64) * _U64(2) + _U64(1)


class _WordHashes(dict):
    """Hashes of words, kept while the worker lives, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHED_BYTES:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; fewer words than the width make one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, _U64)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U64, len(words))
    n = min(width, len(h))
    x = np.full(len(h) - n + 1, n, _U64)
    for k in range(n):
        x += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    x ^= x >> _U64(29)
    x *= _FACTORS[15]
    x ^= x >> _U64(32)
    return np.unique(x)


def minwise(x: np.ndarray) -> np.ndarray:
    """The least product of the set with each factor: equal sets' tokens are equal, others' as often as the sets are similar."""
    out = np.empty(TREES * LEVELS, _U64)
    for k in range(TREES * LEVELS):
        out[k] = (x * _FACTORS[16 + k]).min()
    return out


def paths(tokens: np.ndarray) -> np.ndarray:
    """TREES x DEPTHS keys of nodes."""
    t = tokens.reshape(TREES, LEVELS)
    key = np.arange(1, TREES + 1, dtype=_U64) * _FACTORS[14]
    keys = []
    for level in range(LEVELS):
        key = (key ^ t[:, level]) * _FACTORS[13]
        key ^= key >> _U64(31)
        if level + 1 in DEPTHS:
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, sketch, and the node keys of each tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sizes, digests, sketches, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                x = shingles(text.as_py() or b"", width)
                sizes.append(len(x))
                if not len(x):
                    digests.append(None), sketches.append(None), keys.append(None)
                    continue
                t = minwise(x)
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                sketches.append((t >> _U64(24)).astype(np.uint8).tobytes())
                keys.append(paths(t).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sketch", "keys"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, keys array<array<long>>"
    )


def nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block, id, sketch) for the leaders, with oversize nodes branched; and (node, n, id, sketch) of all nodes of the first depth."""
    rows = classes.select("id", "sketch", F.explode("keys").alias("path"))
    found, whole = [], None
    for depth in range(len(DEPTHS)):
        key = F.get("path", F.lit(depth))
        counts = rows.groupBy(key.alias("node")).agg(F.count("*").alias("n")).where("n > 1")
        here = checkpointed(rows.join(counts, key == F.col("node")).select("id", "sketch", "path", "node", "n"))
        whole = here.select("node", "n", "id", "sketch") if whole is None else whole
        found.append(here.where(f"n <= {NODE_LIMIT}").select("node", F.lit(0).cast("long").alias("block"), "id", "sketch"))
        large = here.where(f"n > {NODE_LIMIT}")
        if large.isEmpty():
            break
        rows = large.drop("node", "n")
    else:
        block = F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("n") / NODE_LIMIT))
        found.append(large.select("node", block.alias("block"), "id", "sketch"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, whole


def faced(labelled: DataFrame) -> DataFrame:
    """(node, block, id, comp, sketch): blocks in which any two members of a node that are in different components meet.

    In an oversize node the members of its largest component don't need to meet each other: their
    blocks meet those of the other members, and these meet one another.
    """
    rows = labelled.select("node", "id", "comp", "sketch")
    small = rows.where(labelled["n"] <= NODE_LIMIT).withColumn("block", F.lit(0).cast("long"))
    large = rows.where(labelled["n"] > NODE_LIMIT)
    sizes = large.groupBy("node", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy(F.col("node").alias("at")).agg(
        F.max_by("comp", F.struct("size", "comp")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("total")
    )
    half = NODE_LIMIT // 2
    a, b = F.ceil(F.col("most") / half), F.ceil((F.col("total") - F.col("most")) / half)
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("id"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("id"), F.col("b")))
    met = F.sequence(F.when(is_main, F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)
    pair = F.transform(met, lambda k: F.greatest("own", k) * (F.col("a") + F.col("b")) + F.least("own", k))
    placed = large.join(main.where("most < total"), F.col("node") == F.col("at")).withColumns({"a": a, "b": b}).withColumn("own", own)
    blocks = placed.select("node", "id", "comp", "sketch", F.explode(pair).alias("block"))
    return small.unionByName(blocks).select("node", "block", "id", "comp", "sketch")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of sketches b look as similar as least to sketch a; one in 256 bytes is equal by chance."""
    same = np.count_nonzero(b == a, axis=1) / b.shape[1]
    return (same - 1 / 256) / (1 - 1 / 256) >= least


def _by_node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (node, block) after the other, from rows sorted by these two."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        key = np.stack([table["node"].to_numpy(), table["block"].to_numpy().astype(np.int64)], 1)
        cut = [0, *((key[1:] != key[:-1]).any(1).nonzero()[0] + 1)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                yield table.slice(i, j - i)
        kept = table.slice(cut[-1])
    if kept is not None and kept.num_rows > 1:
        yield kept


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _keyed(members: DataFrame, *columns: str) -> DataFrame:
    return members.repartition("node", "block").sortWithinPartitions("node", "block").select("node", "block", *columns)


def leaders(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b: in each node, the member that most others look like meets all of those, then the rest go on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            ids, s = table["id"].to_numpy(), _sketches(table)
            order = np.argsort(ids, kind="stable")
            ids, s = ids[order], s[order]
            like = np.stack([_alike(x, s, least) for x in s])
            np.fill_diagonal(like, False)
            a, b = [], []
            while (degree := like.sum(1)).any():
                head = int(degree.argmax())
                near = like[head].nonzero()[0]
                a.append(np.minimum(ids[head], ids[near]))
                b.append(np.maximum(ids[head], ids[near]))
                like[head] = like[:, head] = False
                like[near] = like[:, near] = False
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return _keyed(members, "id", "sketch").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def unsettled(members: DataFrame, least: float) -> DataFrame:
    """(node, block, id, comp) of the members that look like a member of another component in their node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            comps = table["comp"].to_numpy()
            if comps.min() == comps.max():
                continue
            s = _sketches(table)
            open_ = np.zeros(len(s), bool)
            for k in range(len(s) - 1):
                at = k + 1 + (comps[k + 1 :] != comps[k]).nonzero()[0]
                if len(at) and (hit := at[_alike(s[k], s[at], least)]).size:
                    open_[k] = open_[hit] = True
            if open_.any():
                yield table.filter(pa.array(open_)).select(["node", "block", "id", "comp"]).combine_chunks().to_batches()[0]

    return _keyed(members, "id", "comp", "sketch").mapInArrow(run, "node long, block long, id long, comp long")


def _shipped(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """wanted (any long and int columns, id) with the full shingle set of each id's text; texts has handle and text."""
    names = [c for c in wanted.columns if c != "id"] + ["id"]
    rows = wanted.join(texts, F.col("id") == F.col("handle")).select(*names, "text")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = [shingles(t.as_py() or b"", width).tobytes() for t in part.column(len(names)).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, pa.binary())], names=[*names, "items"])

    return rows.mapInArrow(sets, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", items binary")


def settled(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, by exhaustive comparison of the full sets in each node.

    One member at a time is intersected with all others of its node; of the links found, those are
    returned that join components not yet joined in that node.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            ids, comp = table["id"].to_numpy(), table["comp"].to_numpy().copy()
            sets = [np.frombuffer(x, _U64) for x in table["items"].to_pylist()]
            size = np.array([len(x) for x in sets])
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(values), np.int64)
            a, b = [], []
            for k in range(len(ids) - 1):
                if (comp[k + 1 :] == comp[k]).all():
                    continue
                own = flat[start[k] : start[k] + size[k]]
                mark[own] = 1
                both = np.add.reduceat(mark[flat[start[k + 1] :]], start[k + 1 :] - start[k + 1])
                mark[own] = 0
                for j in k + 1 + (100 * both >= percent * (size[k] + size[k + 1 :] - both)).nonzero()[0]:
                    if comp[j] != comp[k]:
                        comp[comp == comp[j]] = comp[k]
                        a.append(ids[k]), b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _keyed(_shipped(open_, texts, width), "id", "comp", "items").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    placed = pairs.join(sizes.withColumnRenamed("a", "lead"), F.col("a") == F.col("lead")).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk")
    )
    wanted = placed.select("a", "chunk", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        placed.select("a", "chunk", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    )
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, []
        for batch in batches:
            out = []
            for a, chunk, role, i, items in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = np.frombuffer(items, _U64)
                if (a, chunk) != now:
                    now, lead = (a, chunk), []
                if role == 0:
                    lead.append(x)
                else:
                    for y in lead:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    full = _shipped(wanted, texts, width).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return full.select("a", "chunk", "role", "id", "items").mapInArrow(links, "a long, b long").distinct()


def _further(usable: DataFrame) -> DataFrame | None:
    """(f_id, f_hash, f_handle) of the texts whose doc_id has another text of another set; None if there are none.

    The text of the least digest goes by its doc_id, the others by a hash at or above HANDLES.
    """
    sets = usable.groupBy(F.col("doc_id").alias("f_id")).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    several = checkpointed(sets)
    if several.isEmpty():
        return None
    rows = usable.join(several, (F.col("doc_id") == F.col("f_id")) & (F.col("digest") != F.col("low")))
    handle = F.xxhash64("doc_id", "digest").bitwiseAND(F.lit(HANDLES - 1)).bitwiseOR(F.lit(HANDLES))
    return checkpointed(rows.select("f_id", F.col("text_hash").alias("f_hash"), handle.alias("f_handle")).distinct())


def _handled(rows: DataFrame, further: DataFrame | None) -> DataFrame:
    """rows (doc_id, text_hash) with their handle: the doc_id, but for the further texts of one doc_id."""
    if further is None:
        return rows.withColumn("handle", F.col("doc_id"))
    known = rows.join(further, (F.col("doc_id") == F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    return known.withColumn("handle", F.coalesce("f_handle", "doc_id")).drop("f_id", "f_hash", "f_handle")


def find(docs: DataFrame, *, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):  # all Python work ends here: what is returned only joins its tables
        return _found(docs, width, percent)


def _found(docs: DataFrame, width: int, percent: int) -> DataFrame:
    signed = checkpointed(signatures(docs, width))
    further = _further(signed.where("n_shingles > 0 and doc_id is not null"))
    usable = _handled(signed.where("n_shingles > 0 and doc_id is not null"), further)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("text_hash", F.xxhash64("text"))
    texts = _handled(texts, further).select("handle", "text")
    least = usable.groupBy("digest").agg(F.min("handle").alias("id"))
    by_class = least.withColumnRenamed("digest", "d")
    member = checkpointed(usable.join(by_class, F.col("digest") == F.col("d")).select("handle", "id"))
    one = usable.join(by_class, (F.col("digest") == F.col("d")) & (F.col("handle") == F.col("id")))
    classes = one.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))  # rows of one handle are equal
    branched, whole = nodes(classes)
    error = (percent / 100 * (1 - percent / 100) / (TREES * LEVELS)) ** 0.5
    first = leaders(branched, percent / 100 - 1.5 * error)
    links = checkpointed(verified(checkpointed(first), texts, width, percent))
    if further is not None:  # the texts of one doc_id belong together
        of = lambda k: member.select(F.col("handle").alias(f"h{k}"), F.col("id").alias("ab"[k]))
        same = further.join(of(0), F.col("f_id") == F.col("h0")).join(of(1), F.col("f_handle") == F.col("h1"))
        links = checkpointed(links.unionByName(same.select("a", "b").distinct()))
    known = components(links)
    labelled = whole.join(known.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select(
        "node", "n", "id", "sketch", F.coalesce("component", "id").alias("comp")
    )
    open_ = checkpointed(unsettled(faced(labelled), percent / 100 - MARGIN * error))
    if not open_.isEmpty():
        known = components(links.unionByName(settled(open_, texts, width, percent)))
    grouped = member.join(known.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").groupBy("handle").agg(
        F.min(F.coalesce("component", "id")).alias("component")
    )
    rows = _handled(signed.select("doc_id", "text_hash", "n_shingles"), further)
    out = rows.join(grouped.withColumnRenamed("handle", "h"), F.col("handle") == F.col("h"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without rows whose doc_id isn't the least of its group of near duplicates."""
    gone = find(docs, width=width, percent=percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
