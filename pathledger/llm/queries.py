"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.llm.ann import nearest
from pathledger.llm.ctw import score_texts
from pathledger.llm.divergence import source_divergence
from pathledger.llm.embeddings import near_duplicate_vectors
from pathledger.llm.langid import fit_languages, identify_languages
from pathledger.llm.lines import dedup_lines
from pathledger.llm.mixing import mixing_plan
from pathledger.llm.packing import pack_documents
from pathledger.llm.setjoin import near_duplicates
from pathledger.llm.substring import remove_repeated
from pathledger.llm.toxicity import fit_toxicity, score_toxicity
from pathledger.llm.whitening import whiten
from pathledger.llm.winnowing import contamination


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def learned(key: str) -> Column:
    """Rows whose labels may be learned: all but every fourth by a checksum of the key."""
    return ~F.coalesce(fold(key, 4) == 2, F.lit(False))


#: Toxicity from which a document is rejected.
LIMIT = 0.3

#: Edits up to which a line of the pipeline counts as repeated.
LINE_EDITS = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_lines(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **options)
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), kept)


def op4_lines_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op4_lines``, whose SQL says one edit, with the two edits of the pipeline's stage."""
    return op4_lines(spark, sf_dir, max_edits=LINE_EDITS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(learned("doc_id"))
    model = fit_toxicity(docs.filter(learned("doc_id")), labels)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", (~learned("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")
    )


def op7_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(learned("doc_id")))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learned("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned_from = ~F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    scored = score_texts(table(spark, sf_dir, "documents"), learned_from)
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = [
    op1_substring, op2_packing, op3_vectors, op4_lines, op4_lines_two, op5_mixing, op6_toxicity, op7_setjoin,
    op8_language, op9_neighbours, op10_scoring, op11_divergence, op12_whitening, op13_winnowing, pipeline,
]
QUERIES = {f.__name__: f for f in _ALL}
