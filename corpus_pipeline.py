"""A corpus pipeline of five of the library's operators, from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.llm.lines import dedup_lines
from pathledger.llm.mixing import mix_sources
from pathledger.llm.packing import pack_documents
from pathledger.llm.queries import LIMIT, LINE_EDITS, learned, table, tokenizer_path
from pathledger.llm.scratch import Scratch
from pathledger.llm.setjoin import drop_near_duplicates
from pathledger.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit of toxicity; null and empty texts stay."""
    labels = table(spark, sf_dir, "labels").filter(learned("doc_id"))
    model = fit_toxicity(docs.filter(learned("doc_id")), labels)
    return score_toxicity(docs, model, score="__toxicity").filter(F.col("__toxicity") < LIMIT).drop("__toxicity")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those that had nothing else go."""
    rows = dedup_lines(docs, max_edits=LINE_EDITS)
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    rows = rows.filter(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained models and sketches are beyond SQL; tests/llm holds the stages to bounds, not yet to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
