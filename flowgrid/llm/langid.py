"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting: a bounded sample of labelled texts (``per_language`` expected rows of each language, drawn
by a hash of doc_id and text) is turned into n-gram counts where it lies; counts are summed by
(language, bucket), so that the driver gets at most languages x buckets numbers.  The log-probability
matrix (buckets x languages) is broadcast and stays within MATRIX_BYTES: with more than 128 languages
there are fewer buckets, down to 256 (32768 languages; more distinct labels raise an error).
Prediction is one pass without a shuffle: a batch of texts is one sequence of n-gram buckets, which
gather rows of the matrix; the rows' sums by text are the languages' log-likelihoods; classes have
equal priors.  n-grams overlap, so that their likelihoods multiply to certainty on any text: the score
is the posterior of ``evidence`` n-grams that are like the text's on average (fewer in shorter texts).

Cases: null texts and texts without a letter are 'und' with score 0; so is everything if nothing
could be learned.  A null label isn't learned from; an empty one is a label, and rows of null doc_id
are learned from.  Equal likelihoods go to the language that sorts first.  Rows are judged one by one,
so repeated rows get equal results; a very long text is gathered in stretches of CODES characters;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, LEAST_BITS = 16, 8
MATRIX_BYTES = 32 << 20
ORDERS = (1, 2, 3)
#: Characters whose n-grams are scored at once.
CODES = 1 << 17
_GAP = re.compile(r"[\W\d_]+")
#: Odd multipliers of the n-gram hash, by place.
_FACTORS = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def letters(text: str) -> str:
    """A text's letters in lower case; runs of anything else, and both ends, count as one blank."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams that start at each character but the last n - 1."""
    h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * _FACTORS[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Languages in order, and log-probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], logp: np.ndarray, evidence: int = 64):
        self.languages, self.logp, self.evidence = languages, logp, evidence
        self.bits = len(logp).bit_length() - 1
        self.rows = np.concatenate([logp, np.zeros((1, logp.shape[1]))]).astype(np.float32)  # the last row is of no n-gram

    def _scored(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods (texts x languages) of texts of letters that are within CODES together."""
        codes = codes_of("".join(texts))
        ends = np.cumsum([len(x) for x in texts])
        out = np.zeros((len(texts), len(self.languages)))
        for n in ORDERS:
            at = np.full(len(codes), len(self.logp), dtype=np.int64)
            at[: max(0, len(codes) - n + 1)] = buckets(codes, n, self.bits)
            for k in range(1, n):
                at[ends - k] = len(self.logp)  # would reach into the next text
            out += np.add.reduceat(self.rows[at], np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)
        return out

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods (texts x languages) of texts of letters."""
        out = np.zeros((len(texts), len(self.languages)))
        waiting, size = [], 0
        last = max(ORDERS) - 1

        def work() -> None:
            if waiting:
                np.add.at(out, [i for i, _ in waiting], self._scored([x for _, x in waiting]))
                waiting.clear()

        for i, text in enumerate(texts):
            if size + len(text) > CODES:
                work()
                size = 0
            if len(text) <= CODES:
                waiting.append((i, text))
                size += len(text)
                continue
            for start in range(0, len(text), CODES):  # stretches that share an n-gram's length less one, which is taken off again
                out[i] += self._scored([text[start : start + CODES + last]])[0]
                if start + CODES < len(text):
                    out[i] -= self._scored([text[start + CODES : start + CODES + last]])[0]
        work()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if at:
            read = [letters(texts[i]) for i in at]
            total = self.likelihoods(read)
            grams = np.array([sum(max(0, len(x) - n + 1) for n in ORDERS) for x in read])
            best = total.argmax(1)
            rest = (total - total[np.arange(len(at)), best][:, None]) * np.minimum(1, self.evidence / grams)[:, None]
            for i, k, s in zip(at, best, 1 / np.exp(rest).sum(1), strict=True):
                pred[i], score[i] = self.languages[k], float(s)
        return pred, score


def fit(labelled: DataFrame, *, per_language: int = 2000, alpha: float = 0.5, evidence: int = 64) -> Model:
    """A model from (doc_id, text, lang), of about ``per_language`` rows of each language."""
    most = MATRIX_BYTES // 4 >> LEAST_BITS
    named = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), evidence)
    bits = min(BITS, (MATRIX_BYTES // 4 // len(languages)).bit_length() - 1)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def add(lang: str, texts: list[str]) -> None:
            for text in texts:
                codes = codes_of(text)
                for n in ORDERS:
                    for start in range(0, len(codes) - n + 1, CODES):
                        sums[lang] += np.bincount(buckets(codes[start : start + CODES + n - 1], n, bits), minlength=1 << bits)

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(letters(text.as_py()))
            for lang, texts in by_lang.items():
                sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                add(lang, texts)
        for lang, x in sums.items():
            at = x.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at])], names=["lang", "bucket", "n"])

    sample = named.where(drawn).select("text", "lang")
    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((1 << bits, len(languages)))
    if rows.num_rows:
        where = {k: i for i, k in enumerate(languages)}
        seen[rows["bucket"].to_numpy(), [where[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    return Model(languages, np.log(seen + alpha) - np.log(seen.sum(0) + alpha * (1 << bits)), evidence)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, by their column ``text``; replaces columns of those names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.logp.astype(np.float32), model.evidence))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                pred, score = own.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def stays(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs (all columns, whatever their names) whose language is known with at least that score."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    known = identify(plain, model, text=f"c{names.index('text')}").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return known.drop("lang_pred", "score").toDF(*names)
