"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes the documents its predecessor kept and is written as Parquet
before the next one starts, so a failure costs one stage.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import decontaminate, langid, linededup, minhash, packing, queries, scratch

#: SQL can express neither cross-parsing nor tokenisers; tests compare run() with a brute-force version
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_finished: list[tuple[int, int]] = []


def _stage(f: Stage) -> Stage:
    """Frees the working tables of the stage before, whose result has been written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _finished:
            scratch.release(*_finished.pop())
        since = scratch.mark()
        out = f(spark, docs, sf_dir)
        _finished.append((since, scratch.mark()))
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents written in some language; rejects null texts and texts without a letter."""
    # where nothing can be trained on, any letter makes a text one of the only language
    samples = langid.sample(docs.where(~queries.held_out())) or {"any": "a"}
    judged = langid.identify(docs, samples)
    return judged.where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites the texts without lines that an earlier document holds; n_chars follows."""
    out = linededup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near copies."""
    judged = minhash.near_duplicates(docs, k=5, share=80)
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.contamination(docs, benchmark, unnamed=True)
    return judged.where(~F.col("contaminated")).select(*docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of 2,048 tokens."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)
    _finished.clear()  # the result still reads the last stage's tables
    return out
