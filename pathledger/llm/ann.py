"""Nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and a fast Hadamard
transform and hashes them to the nearest signed axis. A query looks into the cells of its
nearest axes in every table, and the candidates are ranked by exact Euclidean distance of
the original vectors. Cells are cut into blocks of bounded size by their counts, so that a
cell that holds a large part of all rows is spread over tasks; each block returns its
nearest few for each query.

A query that finds fewer candidates than it asks for looks into all cells instead.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, or
that have no id, take no part; vectors of another length than the query's are no
candidates; ties go to the smaller id; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column


def usable(vector: str) -> F.Column:
    """A vector without null or non-finite components and not all zero."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def vectors(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    values = column(batch, name)
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = values.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def rotate(x: np.ndarray, table: int, seed: int = 7) -> np.ndarray:
    """Pseudo-random rotation of the rows of x, padded with zeros to a power of two."""
    n, d = x.shape
    width = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, width))
    y[:, :d] = x
    for turn in range(3):
        y = y * np.random.default_rng([seed, table, turn]).choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            y = y.reshape(n, -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
            step *= 2
        y /= np.sqrt(width)
    return y


def cells(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first: 2 * axis, + 1 on the negative side."""
    y = rotate(x / np.linalg.norm(x, axis=1, keepdims=True), table)
    axes = np.stack([y, -y], 2).reshape(len(x), -1)
    return np.argsort(-axes, axis=1, kind="stable")[:, :probes]


def _hashed(tables: int, probes: int):
    def run(batches):
        for batch in batches:
            own = vectors(batch, "x")
            ids = column(batch, "id").to_numpy()
            widths = np.array([len(v) for v in own])
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                x = np.stack([own[r] for r in rows])
                for table in range(tables):
                    found = cells(x, table, probes)
                    n = found.shape[1]
                    at = np.repeat(rows, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), width), pa.int32()),
                            pa.array(np.full(len(at), table), pa.int32()),
                            pa.array(found.ravel(), pa.int32()),
                            pa.array(ids[at], pa.int64()),
                            column(batch, "x").take(pa.array(at)),
                        ],
                        names=["width", "tab", "cell", "id", "x"],
                    )

    return run


def _rank(query_ids, queries, ids, rows, k: int) -> pd.DataFrame:
    """The k nearest rows of each query by exact distance, ties to smaller ids."""
    out = []
    for q, x in zip(query_ids, queries, strict=True):
        distance = np.sqrt(((rows - x) ** 2).sum(1))
        distance[ids == q] = np.inf
        own = np.flatnonzero(np.isfinite(distance))
        if len(own) > k:
            bound = np.partition(distance[own], k - 1)[k - 1]
            own = own[distance[own] <= bound]
        own = own[np.lexsort((ids[own], distance[own]))][:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[own], "score": distance[own]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


RANKED = "query_id long, vec_id long, score double"


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, key="vec_id", vector="embedding", tables: int = 8,
            probes: int = 14, block: int = 2000) -> DataFrame:
    """Each query's k nearest rows of ``base`` found, but for its own: query_id, rank, vec_id, score."""
    spark = base.sparkSession
    scratch = Scratch(spark, "ann")
    pick = lambda df: df.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")
    )
    base, queries = pick(base), pick(queries).dropDuplicates(["id"])
    schema = "width int, tab int, cell int, id long, x array<double>"
    index = scratch.write(base.mapInArrow(_hashed(tables, 1), schema))
    asked = scratch.write(queries.mapInArrow(_hashed(tables, probes), schema))
    blocks = index.groupBy("width", "tab", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = scratch.write(blocks)
    where = ["width", "tab", "cell"]
    found = _in_blocks(index, asked, blocks, where, k)
    found = scratch.write(found)
    few = queries.join(
        found.select("query_id", "vec_id").distinct().groupBy("query_id").count().filter(f"count >= {k}"),
        F.col("id") == F.col("query_id"),
        "left_anti",
    )
    # Those with too few candidates look into every cell of the first table.
    first = blocks.filter("tab = 0")
    rest = few.withColumn("width", F.size("x")).join(first.select("width", "tab", "cell"), "width")
    more = _in_blocks(index.filter("tab = 0"), rest.select(*index.columns), first, where, k)
    every = found.unionByName(scratch.write(more)).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _in_blocks(index: DataFrame, asked: DataFrame, blocks: DataFrame, where: list[str], k: int) -> DataFrame:
    """Nearest rows of each query within each block of each cell it asks for."""
    split = index.join(blocks, where).withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "blocks"))
    spread = asked.join(blocks, where).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*where, "block"]

    def rank(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _rank(
            queries["id"].to_numpy(), np.stack(queries["x"]), rows["id"].to_numpy(), np.stack(rows["x"]), k
        )

    left = split.withColumn("block", F.col("block").cast("int")).select(*key, "id", "x")
    return left.groupBy(*key).cogroup(spread.select(*key, "id", "x").groupBy(*key)).applyInPandas(rank, RANKED)
