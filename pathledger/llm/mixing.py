"""Mixing sources to target weights: whole repeats plus one hash-seeded Bernoulli copy.

Words are summed up per source, targets follow from weights and a ceiling of epochs, and
every document is emitted floor(rate) times, once more with probability rate - floor(rate).
The draw is a hash of the document's key, so reruns agree. Each source takes, from 32
fixed seeds, the one whose copies come nearest its target.

Edge cases: null text has size 0; null sources form one group that sorts last; a source
without words has target 0 and its documents go; repeated rows are drawn alike; a null key
is drawn as the empty string; an empty table gives an empty result. Columns of the table
keep their names: those made here begin with ``__mix_`` until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import WORD_PATTERN

SEED_GROUPS = 4  # hashes per document
DRAWS = 8  # draws of 32 bits in each hash


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _draws(key: Column, group: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"mix{group}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") / F.lit(2.0**32) for i in range(DRAWS)]


def _draw(key: Column, seed: Column) -> Column:
    """The draw of one seed: a substring of one hash."""
    label = F.concat(F.lit("mix"), F.floor(seed / DRAWS).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(label, 256), seed % DRAWS * 8 + 1, F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, size) per source to targets; one row per source, so one task ranks them.

    With r = ceiling * size / weight in ascending order, the level that fills the budget is
    the largest of (budget - ceilings of those below) / (weights of the rest): a target is
    the smaller of level * weight and ceiling * size.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1)
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        share * F.sum("size").over(every) - F.coalesce(F.sum(ceiling * F.col("size")).over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    return (
        totals.withColumns({"rank": rank, "weight": weight})
        .withColumn("ratio", ceiling * F.col("size") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("level") * F.col("weight"), ceiling * F.col("size")))
        .withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0))
        .select("source", F.col("size").alias("source_size"), "target", "rate")
    )


def source_rates(sizes: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Targets, rates and seeds by source, from rows of (key, source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    rates = scratch.write(source_targets(totals, **options).withColumn("known", F.lit(True)))
    part = F.col("rate") - F.floor("rate")
    drawn = sizes.join(rates.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    sums = [
        F.sum(F.when(draw < part, F.col("size")).otherwise(0)).alias(f"w{group * DRAWS + i}")
        for group in range(SEED_GROUPS)
        for i, draw in enumerate(_draws(F.col("key"), group))
    ]
    wanted = F.col("source_size") * part
    # The least distance wins, then the first seed.
    best = F.array_min(
        F.array(
            *[
                F.struct(F.abs(F.col(f"w{i}") - wanted).alias("off"), F.lit(i).alias("seed"))
                for i in range(SEED_GROUPS * DRAWS)
            ]
        )
    )
    chosen = drawn.groupBy("source", "source_size", "target", "rate").agg(*sums).withColumn("seed", best["seed"])
    return scratch.write(chosen.select("source", "source_size", "target", "rate", "seed"))


def copies(key: Column, rate: Column, seed: Column) -> Column:
    return (F.floor(rate) + F.when(_draw(key, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame, key="doc_id", text="text", source="source", **options) -> DataFrame:
    """Per document: key, size, source_size, target, copies, taken. Texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    )
    rates = source_rates(sizes, scratch, **options).withColumnRenamed("source", "s")
    rows = sizes.join(rates, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("copies", copies(F.col("key"), F.col("rate"), F.col("seed")))
    return rows.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix_sources(docs: DataFrame, key="doc_id", text="text", source="source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    The rates are a small written table, which Spark broadcasts only while its size allows;
    beyond, a hot source is split by the adaptive join.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    )
    rates = source_rates(sizes, scratch, **options).select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("seed").alias("__mix_seed")
    )
    scratch.drop(sizes)
    rows = docs.join(rates, docs[source].eqNullSafe(F.col("__mix_source")))
    number = copies(docs[key], F.col("__mix_rate"), F.col("__mix_seed"))
    return (
        rows.withColumn("__mix_copies", number)
        .filter("__mix_copies > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
