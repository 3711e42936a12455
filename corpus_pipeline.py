"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the checkpoint
folder as Parquet and reads again as the next stage's documents.  All stages but the last return the
columns of documents.

- language_id fits on the stage's own labelled documents and drops those it rejects: without a letter,
  or with a posterior below MIN_SCORE.
- line_dedup removes repeated multi-line chunks; documents of which nothing is left go.
- near_dup keeps one document (the least doc_id) of each group of near duplicates, on shingles of five
  words at a similarity of 0.8.
- mixing gives each document as many rows as the mix takes copies of it, in training order.
- packing returns the pieces of all sequences (see flowgrid.llm.packing).

Cases: null text is rejected by language_id; empty input gives no rows at any stage.  Rows that are
repeated in full go through language_id and line_dedup together and near_dup keeps all rows of the doc_id it
keeps; mixing treats them as documents of their own.  Ties go to the least doc_id, then to the hash of the text.
Very long texts stay whole in every stage, each held by one task at a time.  Columns beside doc_id,
text, lang and source are passed through by the first four stages, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm import langid, line_dedup, mixing, neardup, packing
from flowgrid.llm.common import ensure_checkpoint_dir, removed
from flowgrid.llm.queries import tokenizer_path

MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.stays(docs, model, MIN_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.cut(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dup", near_dup), ("mixing", mix), ("packing", pack)]

#: The stages' hashes (xxh3, BPE) have no SQL equivalent; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is a table in the shared checkpoint folder, until the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            removed(spark, f"{folder}/{last}")
        last = name
    return docs
