"""The corpus pipeline: quality, line dedup, near-dedup, mixing, tokens. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventara.llm import bpe, lines, mixing, neardup, quality
from ventara.llm.base import Scratch, bucket_of, table
from ventara.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    learned = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 5) != 0).select("doc_id", "quality")
    return quality.accepted(docs, quality.fit(docs, learned))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; n_chars follows the text, and null texts stay null."""
    kept = lines.dedup(docs)
    text = F.when(F.col("text").isNotNull(), F.col(kept.columns[-1])["kept"])
    return kept.withColumns({"text": text, "n_chars": F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length(text), F.lit(0)).cast("bigint"))}).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without id stay."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities."""
    drawn = mixing.mixed(docs)
    return drawn.where(F.col(drawn.columns[-1])["sampled"]).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("neardup", neardup_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back for the next, then it goes.

    Rows with a null id are no near-duplicates and own no line; null and empty texts are scored, weigh nothing and stay null or empty;
    repeated rows stay or go together; an empty table gives an empty result; further columns of any name are carried along.
    """
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    result = scratch.write(STAGES[-1][1](spark, docs, sf_dir), "result")
    scratch.drop_but("result")
    return result
