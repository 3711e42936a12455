"""Cost-balanced packing of tokenized documents into training sequences.

A document's ids fill whole sequences as far as they go.  The rest of each document (under one
sequence) waits in its task until a block of them is there; the block's rests are then taken in
descending length, each put into the sequence of lowest attention cost (linear + quadratic in the
piece's length) that still has room for it.  The block's sequences have exactly as many places as
there are tokens: the last, partial sequence is split into powers of two, which need no padding.
A rest that no sequence can take whole is cut over the cheapest sequences with room.

No shuffle: a task packs its own input, holding one block.  A lost task is simply run again; its
result depends only on its partition's rows and number.

Cases: null text counts as empty (its one id is the end id); empty documents are packed as that
one id; repeated rows are packed as often as they occur; null doc_id is passed through; a very long
text is held by one task with its ids, several times its size; an empty table gives no rows; other
columns are ignored.  Each task ends with at most 11 sequences of a power of two below the capacity.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of strings and ids in each of a Python worker's two generations, and what an entry takes beside them.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200


def word_encoder(tokenizer_path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Ids (little-endian uint32 bytes) of UTF-8 texts.

    A tokenizer that drops white space and splits by a pattern turns each space-separated string into
    ids by itself, so their ids are cached; a new string is split by the tokenizer's own pattern and
    looked up part by part, and only new parts go through the tokenizer's model.  Strings with unusual characters or added tokens are encoded as they are.
    Any other kind of tokenizer encodes whole texts.
    """
    import json
    import re
    import unicodedata
    from array import array

    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def as_ids(ids: list[int]) -> bytes:
        x = array("I", ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def plain(parts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch(parts, add_special_tokens=False)]

    spec = json.loads(tokenizer.to_str())
    suffix = spec["model"].get("end_of_word_suffix")
    steps = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    whole, *parts = plain(["it's\t12\r\n Ab's  xé", "it's", "12", "Ab's", "xé"])
    if not suffix or kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"] or whole != sum(parts, []):
        return lambda texts: [as_ids(x) for x in plain([t.decode() for t in texts])]
    parts_of = regex.compile(split["pattern"]["Regex"]).findall
    usual = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+").fullmatch  # stays below U+0250 in lower case
    added = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
    special = re.compile(added).search if added else None
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    as_bytes = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0x21, 0x250) if not chr(k).isspace()}
    tokenize = tokenizer.model.tokenize

    class Strings(dict):
        def __missing__(self, w: bytes) -> bytes:
            return learn(w)

    # Two generations: at the bound the younger becomes the older, and what is asked for again moves on from there.
    strings, old_strings, kept = Strings(), Strings(), 0
    pieces: dict[str, bytes] = {}
    old_pieces: dict[str, bytes] = {}

    def learn(w: bytes) -> bytes:
        nonlocal kept
        ids = old_strings.get(w)
        if ids is None:
            s = w.decode()
            if not usual(s) or special and special(s):
                ids = as_ids(plain([s])[0])
            else:
                ids = b""
                for x in parts_of((s if s.isascii() else unicodedata.normalize("NFC", s)).lower()):
                    got = pieces.get(x)
                    if got is None:
                        got = old_pieces.get(x)
                        if got is None:
                            got = as_ids([t.id for t in tokenize(x if x.isascii() else x.translate(as_bytes))])
                        pieces[x] = got
                        kept += len(x) + len(got) + ENTRY_BYTES
                    ids += got
        strings[w] = ids
        kept += len(w) + len(ids) + ENTRY_BYTES
        return ids

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal kept, strings, pieces, old_strings, old_pieces
        if kept > CACHE_BYTES:
            old_strings, old_pieces, strings, pieces, kept = strings, pieces, Strings(), {}, 0
        return [b"".join(map(strings.__getitem__, t.split())) for t in texts]  # bytes: at ASCII white space alone

    return encode


_ENCODERS: dict[str, Callable] = {}


def encoder(tokenizer_path: str) -> Callable[[list[bytes]], list[bytes]]:
    """The worker's encoder for this file; workers that are used again keep its cache."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = word_encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length), for items shorter than the capacity.

    Every sequence is full: capacities are as many whole ones as there are tokens for, and powers of
    two for what remains.
    """
    total = sum(lengths)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    room, cost = np.asarray(sizes, dtype=np.int64), np.zeros(len(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            k = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n = min(left, int(room[k]))
            out[k].append((item, start, n))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 512,
    block: int = 4096,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their places in sequences; see the module."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # doc_id, start, ids, doc_tokens
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for pieces in balance([len(x[2]) // 4 for x in waiting], capacity, linear, quadratic):
                offset = 0
                for i, start, n in pieces:
                    doc, begin, ids, tokens = waiting[i]
                    rows.append((doc, begin + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence, offset))
                    offset += n
                sequence += 1
            waiting.clear()

        def emit() -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
            rows.clear()
            return out

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield from zip(part.column(0).to_pylist(), (ids + end for ids in encode(texts)), strict=True)

        for batch in batches:
            for doc, ids in encoded(batch):
                tokens = len(ids) // 4
                full = tokens - tokens % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), tokens, sequence, 0))
                    sequence += 1
                if full < tokens:
                    waiting.append((doc, full, ids[4 * full :], tokens))
                if len(waiting) >= block:
                    flush()
                if len(rows) >= 50_000:
                    yield emit()
        flush()
        yield emit()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
