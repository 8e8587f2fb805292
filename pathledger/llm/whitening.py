"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, floor(1024 c) + 100000, whose sums and means are exact; the
rows less their mean are the matrix X. Every step of the bidiagonalisation is one pass: the
driver sends a direction p, tasks form X p and the earlier left vectors, and send back the
sums for X'(X p), the products with the earlier left vectors, and the length. Left vectors
are never stored: each is X w for a w of the size of one row, so that orthogonalising them
is arithmetic on the driver. Right vectors are orthogonalised twice against all earlier
ones. The singular vectors and values of the small bidiagonal matrix give the components
and deviations. Where a step ends in nothing, it starts again in a random direction
orthogonal to all before, so repeated and vanishing deviations are found as well.

Rows travel as blocks of numbers of bounded size, written once and read by each pass. The
driver holds the matrices of the steps (at most dimension x dimension) and one row of sums.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries, or
entries beyond 2^42, are dropped; if vectors of several lengths remain, those of the most
frequent length (of the greater one on a tie) are fitted and returned; zero vectors take
part; rows without an id are returned with a null one; repeated rows are rows of their own;
components whose deviation is below 1e-9 of the largest one don't exist, so an empty table,
a single row or equal rows give no rows; deviation sums beyond a long are null; columns of
the input other than id and vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column

SCALE, SHIFT = 1024.0, 100_000
LARGEST = float(1 << 42)
BLOCK_BYTES = 2 << 20
RANK = 1e-9  # deviations below this part of the largest one are nothing but rounding


@dataclass
class Whitening:
    """A fitted transformation: ``(x - sums / n) @ components.T / sqrt(eigenvalues)``."""

    n: int
    sums: list[int]
    components: np.ndarray  # one row each
    eigenvalues: np.ndarray
    trace: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components.T / np.sqrt(self.eigenvalues)


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _pack(width: int):
    rows = max(1, BLOCK_BYTES // (8 * width))

    def run(batches):
        for batch in batches:
            vectors, ids = column(batch, "x"), column(batch, "id")
            for at in range(0, batch.num_rows, rows):
                part = vectors.slice(at, rows)
                x = whole(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width))
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([ids.slice(at, rows).to_pylist()], pa.list_(pa.int64())),
                    "x": [x.tobytes()],
                    "sums": pa.array([x.sum(0)], pa.list_(pa.int64())),
                })

    return run


def _blocks(batches, width: int):
    for batch in batches:
        for blob in column(batch, "x"):
            yield np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, width)


def _summed(blocks: DataFrame, width: int, partial) -> np.ndarray:
    """The sum of ``partial(block)``, arrays of one length, over all blocks: one row a task, then JVM sums."""

    def run(batches):
        total = None
        for x in _blocks(batches, width):
            part = partial(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total], pa.list_(pa.float64()))})

    parts = blocks.select("x").mapInArrow(run, "part array<double>")
    rows = parts.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(len(rows))
    for row in rows:
        out[row.pos] = row.s
    return out


def _step(mean: np.ndarray, direction: np.ndarray, left: np.ndarray):
    """X'p, (X left)'p and p'p for p = X direction."""

    def partial(x):
        centred = x - mean
        p = centred @ direction
        return np.concatenate([centred.T @ p, (centred @ left).T @ p, [p @ p]])

    return partial


def _against(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        if basis:
            q = np.stack(basis)
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(product, width: int, wanted: int, seed: int = 11):
    """Right vectors (rows) and bidiagonal matrix of the matrix behind ``product``.

    ``product(direction, left)`` returns what ``_step`` sums. Stops once the ``wanted``
    largest singular triplets have no residual left, or when the space is exhausted.
    """
    rng = np.random.default_rng(seed)

    def fresh():
        v = _against(rng.standard_normal(width), right)
        return v / np.linalg.norm(v)

    right, left, images, alphas, betas = [], [], [], [], []
    v, beta, norm = fresh(), 0.0, 0.0
    while True:
        direction = v - beta * left[-1] if beta else v
        basis = np.stack(left, 1) if left else np.zeros((width, 0))
        sums = product(direction, basis)
        image, along, square = sums[:width], sums[width:-1], sums[-1]
        # Less what lies along the earlier left vectors, whose images are known.
        length = float(np.sqrt(max(0.0, square - along @ along)))
        norm = max(norm, length)
        if length <= RANK * 1e-3 * norm or norm == 0:
            if not beta:
                break  # a random direction finds nothing more
            # The chain ends here; its last coupling is kept by a column without diagonal.
            right.append(v)
            left.append(np.zeros(width))
            images.append(np.zeros(width))
            alphas.append(0.0)
            betas.append(0.0)
            if len(right) == width:
                break
            v, beta = fresh(), 0.0
            continue
        if len(along):
            direction = direction - basis @ along
            image = image - np.stack(images, 1) @ along
        right.append(v)
        left.append(direction / length)
        images.append(image / length)
        alphas.append(length)
        v = _against(images[-1] - length * right[-1], right)
        beta = float(np.linalg.norm(v))
        size = len(alphas)
        if size == width:
            betas.append(0.0)
            break
        if beta <= RANK * 1e-3 * norm:
            v, beta = fresh(), 0.0
        else:
            v = v / beta
        betas.append(beta)
        if beta and size > wanted:
            p, s, _ = np.linalg.svd(_matrix(alphas, betas))
            if (beta * np.abs(p[-1, :wanted]) <= 2e-16 * s[0]).all():
                break
    return np.array(right).reshape(-1, width), _matrix(alphas, betas)


def _matrix(alphas, betas) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: max(0, len(alphas) - 1)], 1)


def _prepare(rows: DataFrame, key: str, vector: str, scratch: Scratch):
    """Blocks of whole numbers, their number, sums and width; None without any row."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    good = rows.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(
        F.coalesce((F.size("x") > 0) & ~bad, F.lit(False))
    )
    widths = good.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return None
    width = common.width
    blocks = scratch.write(
        good.filter(F.size("x") == width).mapInArrow(_pack(width), "ids array<long>, x binary, sums array<long>")
    )
    totals = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    sums = [row.s for row in sorted(totals, key=lambda row: row.pos)]
    return blocks, int(common.n), sums, width


def _fit(blocks: DataFrame, n: int, sums: list[int], width: int, components: int) -> Whitening:
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, width, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    wanted = min(components, width)
    if trace > 0:
        right, matrix = bidiagonalise(
            lambda direction, left: _summed(blocks, width, _step(mean, direction, left)), width, wanted
        )
        _, deviations, rotation = np.linalg.svd(matrix)
        found = int((deviations[:wanted] > RANK * deviations[0]).sum())
        axes = rotation[:found] @ right
        axes /= np.linalg.norm(axes, axis=1, keepdims=True)
        return Whitening(n, sums, axes, deviations[:found] ** 2 / n, trace, len(right))
    return Whitening(n, sums, np.zeros((0, width)), np.zeros(0), trace, 0)


def fit_whitening(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The transformation alone; None for a table without usable vectors."""
    prepared = _prepare(rows, key, vector, Scratch(rows.sparkSession, "whitening"))
    return None if prepared is None else _fit(*prepared, components)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 of each row; null beyond a long."""
    reach = max(n * max(abs(int(x.min())), abs(int(x.max()))), max(abs(s) for s in sums))
    if reach < 1 << 61:
        y = n * x - np.array(sums, np.int64)
        if float(np.abs(y).max()) ** 2 * x.shape[1] < 9e18:
            return (y * y).sum(1).tolist()
        y = y.astype(object)
    else:
        y = n * x.astype(object) - np.array(sums, object)
    totals = [int(t) for t in (y * y).sum(1)]
    return [t if t < 1 << 63 else None for t in totals]


_ROWS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _transform(model: Whitening, error: float):
    mean, projection = model.mean, model.projection
    n, sums, width = model.n, model.sums, len(model.sums)
    count = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches):
        for batch in batches:
            for ids, blob in zip(column(batch, "ids"), column(batch, "x"), strict=True):
                x = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, width)
                rows = len(x)
                index = pa.array(np.repeat(np.arange(rows), count))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.values.take(index),
                    "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * count, n)),
                    "deviation": pa.array(_deviations(x, n, sums), pa.int64()).take(index),
                    "whitened": pa.array(((x - mean) @ projection).ravel()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * count, error)),
                })

    return run


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    prepared = _prepare(rows, key, vector, Scratch(spark, "whitening"))
    model = None if prepared is None else _fit(*prepared, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], _ROWS)
    blocks, _, _, width = prepared
    mean, projection, count = model.mean, model.projection, len(model.eigenvalues)

    def moments(x):
        y = (x - mean) @ projection
        return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

    sums = _summed(blocks, width, moments) / model.n
    middle = sums[count * count :]
    covariance = sums[: count * count].reshape(count, count) - np.outer(middle, middle)
    error = float(np.abs(covariance - np.eye(count)).max())
    return blocks.select("ids", "x").mapInArrow(_transform(model, error), _ROWS)
