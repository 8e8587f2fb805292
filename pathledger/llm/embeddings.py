"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of one label form a class with one representative. Representatives of a label
are dealt to tiles; every pair of tiles is one bounded task that multiplies int8 vectors
(exactly, as integers held in float32) and recomputes in double precision only the pairs
whose error bound allows the threshold.

With x unit, x = s q + e and r = |e|, the product of x and y differs from that of s q and
t p by at most r_y + r_x (1 + r_y), which holds for every pair.

A tile task returns sums of links per representative and, for components, one edge per
linked representative to the smallest of its group within the task, so that a dense group
leaves no more rows than it has members.

Edge cases: rows whose vector is null, empty, zero or holds null or non-finite components,
or whose label is null, link with nothing; vectors of different lengths don't link; a row
without an id is returned with its own (null) component; repeated rows are rows of their
own and copies of one another; columns of the input other than id, vector and label are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.ann import usable
from pathledger.llm.graph import components
from pathledger.llm.scratch import Scratch

SLACK = 1e-9  # for rounding in double precision, far above what 10^4 dimensions lose


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what is lost of each row."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - scale[:, None] * q) ** 2).sum(1))
    return q, scale, lost


def possible(a, b, threshold: float) -> np.ndarray:
    """Which pairs of two quantised tiles may reach the threshold."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    # Sums of products stay below 2^24, so float32 holds them exactly, for up to 1040 dimensions.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    return product + rb[None, :] + ra[:, None] * (1 + rb[None, :]) + SLACK >= threshold


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two tiles, or within one (first < second) if y is None."""
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    a = quantise(unit(x))
    b = a if y is None else quantise(unit(y))
    other = x if y is None else y
    found = []
    for lo in range(0, len(x), 512):
        mask = possible(tuple(v[lo : lo + 512] for v in a), b, threshold)
        if y is None:
            mask &= np.arange(len(x))[None, :] > np.arange(lo, lo + len(mask))[:, None]
        i, j = np.nonzero(mask)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            sure = cosines(x[p], other[q]) >= threshold
            found.append((p[sure], q[sure]))
    return tuple(np.concatenate([f[k] for f in found] + [np.zeros(0, np.int64)]) for k in (0, 1))


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and their links, the smallest node that each reaches."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tile", "rep"])
        x, reps = np.stack(frame["x"]).astype(np.float64), frame["rep"].to_numpy()
        weight, tile = frame["copies"].to_numpy(), frame["tile"].to_numpy()
        if tile[0] == tile[-1]:
            if frame["left"].iloc[0] != frame["right"].iloc[0]:
                i = j = np.zeros(0, np.int64)
            else:
                i, j = tile_links(x, None, threshold)
        else:
            cut = int(np.searchsorted(tile, tile[-1]))
            i, j = tile_links(x[:cut], x[cut:], threshold)
            j = j + cut
        links = np.bincount(i, weight[j], len(reps)) + np.bincount(j, weight[i], len(reps))
        order = np.argsort(reps, kind="stable")
        place = np.empty(len(reps), np.int64)
        place[order] = np.arange(len(reps))
        root = reps[order][smallest_linked(len(reps), place[i], place[j])[place]]
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": reps[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def near_duplicate_vectors(rows: DataFrame, key="vec_id", vector="embedding", label="label",
                           threshold: float = 0.93, tile: int = 1024) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    base = rows.select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), F.col(label).alias("label"),
        (usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()).alias("ok"),
    )
    good = base.filter("ok")
    classes = scratch.write(
        good.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("width", F.size("x"))
    )
    group = ["label", "width"]
    tiles = classes.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(scratch.write(tiles), group).withColumn(
        "tile", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("tiles")).cast("int")
    )
    # A tile meets every other tile of its group once: with itself, as the left and as the right one.
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns(
        {"left": F.least("tile", "other"), "right": F.greatest("tile", "other")}
    )
    found = scratch.write(
        pairs.select(*group, "left", "right", "tile", "rep", "copies", "x")
        .groupBy(*group, "left", "right")
        .applyInPandas(_compare(threshold), "rep long, links long, root long")
    )
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = scratch.write(found.groupBy("rep").agg(F.sum("links").alias("links")))
    # Copies share the class of their vector; equal rows of a class are told apart by nothing else.
    described = (
        classes.select("label", "x", "rep", "copies")
        .join(links, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label", "x",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    described = scratch.write(described)
    linked = good.drop("ok").join(described, ["label", "x"]).select("id", "n_links", "component_id")
    alone = base.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
