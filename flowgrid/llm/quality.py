"""Quality rules: distribution divergence from language references, in DataFrame expressions alone.

1. The words of all labelled documents are counted by language; the TOP most frequent ones of each
   (ties by the word) are its common words; their shares of all words, and the share of all other
   words together, are its reference.
2. One pass measures each text: base measures, a histogram over character classes, and one over the
   common words of its language and all other words.  The measures, some hundred bytes a document, are written to
   the checkpoint folder.
3. Character classes, summed over a language's documents that pass the base rules, are its other
   reference.  A document is rejected if the Jensen-Shannon distance (base 2, from 0 to 1) of its
   character classes or of its common words to its language's reference exceeds the threshold.

Guards: texts under ``least_chars`` aren't judged, by words they aren't with fewer than ``least_words``
of them, and no text counts for a reference under ``least_chars``.  A language of fewer than
``least_documents`` documents in its reference has none: its documents, and those of null language,
are held against the classes of all documents, and aren't judged by their words.

References are one row a language.  If all of them are within BROADCAST_BYTES they are broadcast;
beyond that they are joined by a shuffle.  Up to MOST_LITERALS common words of all languages together
stand in the plan as one hash set; beyond that each text is held against its language's own list.

Cases: null text counts as empty (no words, base_failed); repeated rows get equal results; an empty
lang is a language; a very long text is held by one task, with its words and their windows as arrays;
an empty table gives no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowgrid.llm.common import SPACE, checkpointed

SYMBOLS = "#*$%&|<>"
#: Character classes, apart from symbols, space and the rest.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "stop": r".,;:!?'\"()\-"}
#: Common words of a language.
TOP = 50
BROADCAST_BYTES = 32 << 20
MOST_LITERALS = 20_000


def let(value: Column, body) -> Column:
    """body(value) with the value made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more in it."""

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.expr("cast(array() as array<int>)"))
        hashed = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at"))
        return F.sort_array(F.transform(at, hashed))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"]))

    def covered(p: Column) -> Column:
        step = lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    return let(let(let(words, windows), twice), covered)


def run_lengths(words: Column) -> Column:
    """(word, n) of each distinct word of a sorted array."""
    first = lambda x, k: F.when(F.coalesce(F.get(words, k - 1) != x, F.lit(True)), F.struct(x.alias("word"), k.alias("at")))
    starts = F.filter(F.transform(words, first), lambda x: x.isNotNull())
    length = lambda s: F.transform(s, lambda x, k: F.struct(x["word"].alias("word"), (F.coalesce(F.get(s, k + 1)["at"], F.size(words)) - x["at"]).cast("long").alias("n")))
    return let(starts, length)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def letter_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def common_words(docs: DataFrame, least_chars: int) -> DataFrame:
    """(lang, words, shares): each language's most frequent words in order; their shares, and behind them that of all other words."""
    long_enough = _read(docs).where(F.col("lang").isNotNull() & (F.length("text") >= least_chars))
    counts = long_enough.select("lang", F.explode(letter_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= TOP)
    found = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("w"), F.sum("n").alias("top"))
    found = found.join(counts.groupBy("lang").agg(F.sum("n").cast("double").alias("total")), "lang")  # both are a row a language
    others = F.array((F.col("total") - F.col("top")) / F.col("total"))
    return found.select("lang", F.col("w.word").alias("words"), F.concat(F.transform("w", lambda x: x["n"] / F.col("total")), others).alias("shares"))


def _by_language(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows with the columns of their language's row in refs (null where there is none)."""
    size = sum((F.octet_length(F.to_json(F.struct(c))) for c in refs.columns), F.lit(200))
    if (refs.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        refs = F.broadcast(refs)
    return rows.join(refs.withColumnRenamed("lang", "ref_lang"), F.col("lang") == F.col("ref_lang"), "left").drop("ref_lang")


def measures(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Base measures, character-class counts and counts of the language's common words of each text."""
    text = F.col("text")
    length = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = _by_language(_read(docs), common.select("lang", "words"))
    # One measure of the words at a time: the array is made once for both.
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again")))
    of_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    listed = [r.w for r in common.select(F.explode("words").alias("w")).distinct().limit(MOST_LITERALS + 1).collect()]
    is_common = (lambda x: x.isin(listed)) if 0 < len(listed) <= MOST_LITERALS else lambda x: F.array_contains(F.col("words"), x)
    found = lambda a: F.struct(F.size(a).alias("n"), let(F.array_sort(F.filter(a, is_common)), run_lengths).alias("words"))
    out = read.select(
        "doc_id",
        "lang",
        of_words.alias("w"),
        of_lines.alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_chars"),
        length(SPACE).alias("word_chars"),
        length(f"[^{SYMBOLS}]+").alias("n_symbols"),
        *[length(f"[^{c}]+").alias(f"c_{k}") for k, c in CLASSES.items()],
        F.when(F.col("words").isNotNull(), let(F.filter(letter_words(text), lambda x: x != ""), found)).alias("common"),
    )
    seen = sum((F.col(f"c_{k}") for k in CLASSES), F.col("n_symbols"))
    histogram = F.array(*[F.col(f"c_{k}") for k in CLASSES], F.col("n_symbols"), F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - seen)
    failed = (F.col("w.n") < 50) | (100 * F.col("w.again") > 50 * F.col("w.n"))
    return out.select(
        "doc_id", "lang", "n_chars", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("w.again").alias("n_repeat_words"), failed.alias("base_failed"), histogram.alias("classes"),
        F.coalesce("common.n", F.lit(0)).alias("n_letter_words"), F.col("common.words").alias("common"),
    )


def class_references(measured: DataFrame, least_chars: int) -> DataFrame:
    """(lang, n_docs, class_ref): shares of character classes; the row of null lang is of all documents."""
    n = len(CLASSES) + 3
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n)]
    by_lang = measured.where(~F.col("base_failed") & (F.col("n_chars") >= least_chars)).groupBy("lang").agg(F.count("*").alias("n_docs"), *sums)
    every = by_lang.agg(F.sum("n_docs").alias("n_docs"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]).where("n_docs > 0")
    both = by_lang.where("lang is not null").unionByName(every.withColumn("lang", F.lit(None).cast("string")))
    total = F.greatest(sum((F.col(f"c{k}") for k in range(n)), F.lit(0)), F.lit(1)).cast("double")
    return both.select("lang", "n_docs", F.array(*[F.col(f"c{k}") / total for k in range(n)]).alias("class_ref"))


def _part(p: Column, q: Column) -> Column:
    """One value's share of twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def class_distance() -> Column:
    total = F.greatest(F.col("n_chars"), F.lit(1)).cast("double")
    parts = F.zip_with("classes", "class_ref", lambda c, q: _part(c / total, q))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def common_distance() -> Column:
    """Common words that the text lacks add their whole share; all other words are one bin."""
    total = F.greatest(F.col("n_letter_words"), F.lit(1)).cast("double")
    shares = F.map_from_arrays("words", F.slice("shares", 1, F.size("words")))

    def far(ref: Column) -> Column:
        own = F.filter(F.transform("common", lambda e: F.struct(e["n"].alias("n"), F.try_element_at(ref, e["word"]).alias("q"))), lambda e: e["q"].isNotNull())

        def over(e: Column) -> Column:
            there = F.aggregate(e, F.lit(0.0), lambda s, x: s + _part(x["n"] / total, x["q"]) - x["q"])
            p = F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + x["n"]) / total
            others = F.element_at("shares", -1)
            return there + (1 - others) + _part(1 - p, others)

        return let(own, over)

    return F.sqrt(F.greatest(let(shares, far) / 2, F.lit(0.0)))


def judge(
    docs: DataFrame,
    *,
    max_class_distance: float = 0.25,
    max_common_distance: float = 0.5,
    least_chars: int = 200,
    least_words: int = 50,
    least_documents: int = 20,
) -> DataFrame:
    """doc_id, base measures, base_failed, both distances (null: not judged) and kept."""
    common = checkpointed(common_words(docs, least_chars))
    measured = checkpointed(measures(docs, common))
    classes = checkpointed(class_references(measured, least_chars))
    whole = classes.where("lang is null").select(F.col("class_ref").alias("whole_ref"))  # one row at most
    own = classes.where(F.col("lang").isNotNull() & (F.col("n_docs") >= least_documents)).drop("n_docs").join(common, "lang", "left")
    pairs = _by_language(measured, own).join(F.broadcast(whole), F.lit(True), "left")
    known = F.col("class_ref").isNotNull()
    judged = pairs.withColumns({"known": known, "class_ref": F.coalesce("class_ref", "whole_ref")}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("n_chars") >= least_chars, class_distance()).alias("class_distance"),
        F.when((F.col("n_letter_words") >= least_words) & F.col("known"), common_distance()).alias("common_distance"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("common_distance", F.lit(0.0)) > max_common_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
