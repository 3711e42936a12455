"""Secret scans in DataFrame expressions alone.

Base kinds (assignments, access ids, long hex runs) are regular expressions; a text is split at a
pattern's matches, so that the lengths of pieces and matches add up to positions in code points.
On top, runs of token characters are scanned with a sliding window: the window's character counts
are carried along (one character comes in, one goes out) with the sum of c*log2(c), which gives the
window's Shannon entropy in bits.  Each character class (hex, mixed) has its window and threshold; a
run shorter than the window is one window, with the threshold scaled by the logarithm of its length.
What an allow-list pattern or a base span covers is cut out of a run, and each rest that is long
enough is a run of its own, which reports the stretch of its windows that reach the threshold.

Every row is worked on by itself: no shuffle, no broadcast, no Python.

Cases: null text counts as empty, which has no spans; repeated rows get equal results; null doc_id is
passed through; a very long text is held by one task with its spans, in time about in proportion to
its length; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 12
#: Characters of candidate strings, in the order of their counts.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: (class, what its candidates match, window, least bits).
CLASSES = (("hex", "^[0-9a-fA-F]+$", 16, 3.0), ("mixed", "", 24, 4.0))
#: Candidates that are no secrets: no letters or no digits at all, UUIDs, placeholders.
ALLOWED = (
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i)example|changeme|placeholder|dummy|x{6}",
)
#: Spans gathered at a time.
STRETCH = 256
_SPAN = "array<struct<start:int,rank:int,end:int,word:string>>"


def scanned(rows: Column, step, empty: Column, whole: bool) -> Column:
    """What step(pos, row) = (new pos, entry) makes of rows from 0 on: struct(pos, found).

    In whole texts entries are gathered STRETCH at a time, as appending to one array copies it for each.
    """
    acc = lambda pos, found: F.struct(pos.alias("pos"), found.alias("found"))

    def one(a: Column, x: Column) -> Column:
        pos, entry = step(a["pos"], x)
        return acc(pos, F.array_append(a["found"], entry))

    part = lambda pos, k: F.aggregate(F.slice(rows, k * STRETCH + 1, STRETCH), acc(pos, empty), one)
    joined = lambda a, p: acc(p["pos"], F.array_append(a["found"], p["found"]))
    several = lambda a, k: F.get(F.transform(F.array(part(a["pos"], k)), lambda p: joined(a, p)), F.lit(0))
    if not whole:
        return F.aggregate(rows, acc(F.lit(0), empty), one)
    stretches = F.sequence(F.lit(0), F.floor(F.size(rows) / STRETCH).cast("int"))
    none = F.filter(F.array(empty), lambda _: F.lit(False))
    return F.aggregate(stretches, acc(F.lit(0), none), several, lambda a: acc(a["pos"], F.flatten(a["found"])))


def located(text: Column, pattern: str, rank: int, value_group: int = 0, *, whole: bool = False) -> Column:
    """Spans (start, rank, end, word) of a pattern's leftmost matches; word is the match or a group of it."""
    pieces, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    word = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else match
    empty = F.expr(f"cast(array() as {_SPAN})")

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + F.length(x["piece"])
        end = start + F.length(x["match"])
        return end, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["word"].alias("word"))

    rows = F.arrays_zip(pieces.alias("piece"), match.alias("match"), word.alias("word"))
    rows = F.filter(rows, lambda x: x["match"].isNotNull())  # what stands behind the last match
    found = lambda r: scanned(r, step, empty, whole)["found"]
    found = F.get(F.transform(F.array(rows), found), F.lit(0)) if whole else found(rows)  # the rows are made once
    return F.when(text.rlike(pattern), found).otherwise(empty)


def dense_stretch(word: Column, window: int, least: float) -> Column:
    """struct(lo, hi): from the first to behind the last window of at least so many bits; lo is -1 if there is none."""
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    plogp = lambda c: F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("lo"),
        F.lit(-1).alias("hi"),
    )

    def run(codes: Column) -> Column:
        width = F.least(F.lit(window), F.size(codes))
        bits = F.when(width < window, least * F.log2(width.cast("double")) / math.log2(window)).otherwise(least)

        def step(acc: Column, i: Column) -> Column:
            come = F.get(codes, i)
            gone = F.coalesce(F.get(codes, i - width), F.lit(-1))  # -1: the window isn't full yet
            c_in, c_out = F.get(acc["counts"], come), F.get(acc["counts"], gone)
            counts = F.transform(acc["counts"], lambda c, k: c + (k == come).cast("int") - (k == gone).cast("int"))
            total = F.when(
                come != gone,
                acc["sum"] + plogp(c_in + 1) - plogp(c_in) + F.when(gone >= 0, plogp(c_out - 1) - plogp(c_out)).otherwise(0.0),
            ).otherwise(acc["sum"])
            dense = (i >= width - 1) & (F.log2(width.cast("double")) - total / width >= bits)
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(dense & (acc["lo"] < 0), i - width + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(dense, i + 1).otherwise(acc["hi"]).alias("hi"),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))
        )

    return F.get(F.transform(F.array(codes), run), F.lit(0))  # the codes are made once


def masked(text: Column, spans: Column, *, whole: bool = False) -> Column:
    """text with the stretches of its spans blanked out."""

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        before = text.substr(pos + 1, F.greatest(s["start"] - pos, F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(pos, s["start"]), F.lit(0)))
        return F.greatest(pos, s["end"]), F.concat(before, blank)

    empty = F.expr("cast(array() as array<string>)")
    rest = lambda a: F.concat(F.array_join(a["found"], ""), text.substr(a["pos"] + 1, F.length(text)))
    done = lambda r: F.get(F.transform(F.array(scanned(r, step, empty, whole)), rest), F.lit(0))
    done = F.get(F.transform(F.array(F.array_sort(spans)), done), F.lit(0)) if whole else done(F.array_sort(spans))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def runs(text: Column, *, whole: bool = False) -> Column:
    """Spans of candidate strings."""
    return F.get(F.transform(F.array(text), lambda t: located(t, CANDIDATE, KINDS.index("entropy"), whole=whole)), F.lit(0))  # the text is made once


def _rests(x: Column, pattern: str) -> Column:
    """The candidates left of a candidate's span where a pattern's matches are cut out."""
    moved = lambda y: F.struct(
        (x["start"] + y["start"]).alias("start"), y["rank"].alias("rank"), (x["start"] + y["end"]).alias("end"), y["word"].alias("word")
    )
    return F.transform(runs(masked(x["word"], located(x["word"], pattern, 0))), moved)


def entropy_spans(text: Column, base: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of dense stretches in candidate strings, outside of what allow-list patterns and base spans cover."""
    free = runs(masked(text, base, whole=True), whole=True)
    cut = lambda p: lambda x: F.when(x["word"].rlike(p), _rests(x, p)).otherwise(F.array(x))
    for pattern in allowed:
        free = F.flatten(F.transform(free, cut(pattern)))
    free = F.filter(free, lambda x: ~F.coalesce(*[F.when(x["word"].rlike(p), True) for p in allowed], F.lit(False)))

    def judged(x: Column) -> Column:
        by_class = [F.when(x["word"].rlike(m), dense_stretch(x["word"], w, h)) for _, m, w, h in CLASSES]
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), F.coalesce(*by_class).alias("found"))

    dense = F.filter(F.transform(free, judged), lambda x: x["found"]["lo"] >= 0)
    return F.transform(
        dense,
        lambda x: F.struct(
            (x["start"] + x["found"]["lo"]).alias("start"),
            x["rank"].alias("rank"),
            (x["start"] + x["found"]["hi"]).alias("end"),
            F.lit("").alias("word"),
        ),
    )


def rendered(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat(F.get(names, s["rank"]), F.lit(":"), s["start"], F.lit(":"), s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, *, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, counts of base kinds, sha256 of the base spans, and all spans."""
    text = F.col("text")
    read = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = F.filter(located(text, ASSIGN, 0, 2, whole=True), lambda s: F.length(s["word"]) >= MIN_VALUE)
    base = read.select("doc_id", "text", F.concat(assign, located(text, ACCESS, 1, whole=True), located(text, HEX, 2, whole=True)).alias("base"))
    spans = base.select("doc_id", "base", F.concat(F.col("base"), entropy_spans(text, F.col("base"), allowed)).alias("spans"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
    )
