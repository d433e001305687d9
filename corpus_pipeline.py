"""The corpus pipeline: documents in, encoded clean documents out, stage by stage.

Every stage but the last returns the columns of ``documents``; the last returns
doc_id, n_tokens and ids. Stages are written as Parquet in the shared folder and
read again, so a lost executor costs no more than the stage at hand; what a stage wrote
on its way, and the stage before it, are deleted once its own rows are written.

In every stage null and repeated doc_ids keep their rows unless the stage drops them by
its rule, repeated rows share their fate, extra columns keep their values whatever their
names, very long texts are taken whole, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm import bpe, decontam, lang_id, line_dedup, simhash_dedup
from brickyard.llm.common import discard, materialize, scratch
from brickyard.llm.queries import WORD_BPE, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: null and empty texts and texts without a letter. Rows that stay are unchanged."""
    return lang_id.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates; every document stays, with n_chars of its new text where that changed. Null text stays null."""
    own = {c: f"{c} of the document" for c in ("n_lines", "n_dropped") if c in docs.columns}
    clean = line_dedup.drop_recurring(docs.withColumnsRenamed(own))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group; null texts count as empty, and rows without a doc_id stay."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, all rows of their doc_id; null texts hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row's text: none for a null text. Columns named ids or n_tokens before it are left behind."""
    return bpe.encode(docs.select("doc_id", "text"), WORD_BPE).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]
#: SQL cannot express SimHash, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        kept: list[DataFrame] = []
        with scratch(kept):
            kept.append(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            discard(before)
        docs = before = kept[0]
    return docs
