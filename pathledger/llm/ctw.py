"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes and an end mark. A byte is eight binary decisions; each decision has a
tree of contexts, the bytes before it up to a depth, with Krichevsky-Trofimov counts in
every node. A node's weighted probability of the training decisions is half its own
estimate plus half the product of its children's; the share of the first half is how much
the node's own estimate counts in predictions, mixed over all depths.

The counts cover all training texts and live in no single place. Each task cuts its
documents to chunks of bounded size and writes them as compressed blobs, along with the
distinct (context, byte) runs and words it met. Runs are dealt by their last two context
bytes, so that every tree of depth two and more lies in one part; depths zero and one have
at most 2^17 nodes and are summed up for all. The parts answer each chunk's runs with
their log probabilities, and chunks meet their answers to score their documents.

The base score is the add-half unigram score of lower-cased words and an end token.

Edge cases: null texts are empty and score their end alone; without training texts every
decision has probability 1/2; repeated rows count and are scored as often as they come; a
null key is held out or not as the caller says; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch, partitions
from pathledger.llm.text import column, lower_ascii, mix, slices, text_bytes, word_hashes, word_spans

SLICE = 2 << 20
CHUNK = 24 << 20  # bytes of text that share one set of answers
DEPTH = 5
END_WORD = np.uint64(0x5851F42D4C957F2D)
WORDS, RUNS, DOCS = 0, 1, 2


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, and values along with them."""
    planes = [np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    planes += [v.tobytes() for v in values]
    return np.int64(len(keys)).tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    keys = np.ascontiguousarray(np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    out, at = [np.cumsum(keys, dtype=np.uint64)], 8 * n
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte and its contexts, end marks included, and where each text's keys begin.

    A key holds the DEPTH bytes before, the nearest one highest, then the byte itself.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    pad = DEPTH
    begins = np.concatenate([[0], np.cumsum(sizes + pad + 1)])
    padded = np.zeros(begins[-1], np.uint64)
    place = np.arange(len(data)) + np.repeat(begins[:-1] + pad - offsets[:-1], sizes)
    padded[place] = data
    keys = padded.copy()
    for back in range(1, pad + 1):
        keys[back:] |= padded[:-back] << np.uint64(8 * (pad + 1 - back))
    real = np.ones(len(keys), bool)
    for back in range(pad):
        real[begins[:-1] + back] = False
    return keys[real], begins - np.arange(n + 1) * pad


def doc_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and end tokens, and where each text's begin."""
    low = lower_ascii(data)
    starts, ends, before = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    n = len(offsets) - 1
    begins = before + np.arange(n + 1)
    out = np.full(begins[-1], END_WORD, np.uint64)
    sizes = np.diff(before)
    out[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = words
    return out, begins


def part_of(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    own = keys >> np.uint64(8 * (DEPTH - 1)) if kind == RUNS else keys
    return (mix(own) % np.uint64(parts)).astype(np.int64)


CHUNKS = "kind int, part int, chunk long, payload binary"


def _row(kind: int, part: int, chunk: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())],
        names=["kind", "part", "chunk", "payload"],
    )


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return merged(keys, training.astype(np.float64))


def _chunked(parts: int):
    def flush(chunk: int, met: dict):
        for kind, found in met.items():
            keys, counts = merged(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
            part = part_of(keys, kind, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    yield _row(kind, p, chunk, pack(keys[own], counts[own].astype(np.uint32)))

    def run(batches):
        chunk = TaskContext.get().partitionId() << 24
        met, size = {WORDS: [], RUNS: []}, 0
        for batch in slices(batches, SLICE):
            data, offsets = text_bytes(column(batch, "text"))
            training = column(batch, "training").to_numpy(zero_copy_only=False).astype(bool)
            for kind, (keys, begins) in ((WORDS, doc_words(data, offsets)), (RUNS, runs(data, offsets))):
                met[kind].append(_counted(keys, np.repeat(training, np.diff(begins))))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield _row(DOCS, -1, chunk, sink.getvalue().to_pybytes())
            size += len(data)
            if size >= CHUNK:
                yield from flush(chunk, met)
                chunk, met, size = chunk + 1, {WORDS: [], RUNS: []}, 0
        if met[WORDS]:
            yield from flush(chunk, met)

    return run


def _answer_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of each chunk's words; a row without chunk has distinct and all training tokens."""
    blobs = [unpack(b, np.uint32) for b in frame["payload"]]
    keys, counts = merged(np.concatenate([k for k, _ in blobs]), np.concatenate([c for _, c in blobs]))
    rows = [
        (WORDS, chunk, pack(own, counts[np.searchsorted(keys, own)].astype(np.int64)), 0, 0)
        for chunk, (own, _) in zip(frame["chunk"], blobs, strict=True)
    ]
    rows.append((WORDS, -1, b"", int((counts > 0).sum()), int(counts.sum())))
    return pd.DataFrame(rows, columns=["kind", "chunk", "payload", "distinct", "total"])


def log_factorials(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0, by Stirling's series from 10 on."""
    low = x < 10
    y = np.where(low, x + 10, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(x)
    for i in range(10):
        product = product * np.where(low, x + i, 1)
    return series - np.where(low, np.log(product), 0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with n0 zeros and n1 ones by Krichevsky and Trofimov."""
    return log_factorials(n0 + 0.5) + log_factorials(n1 + 0.5) - log_factorials(n0 + n1 + 1.0) - np.log(np.pi)


class Nodes:
    """Decision nodes of one depth: id = context << 8 | place of the decision in the byte (1 to 255)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: context << 8 | byte, distinct, with their counts."""
        byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
        ids, ones = [], []
        for j in range(8):
            ids.append(context | np.uint64(1 << j) | byte >> np.uint64(8 - j))
            ones.append((byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool))
        flat, one = np.concatenate(ids), np.concatenate(ones)
        self.ids, at = np.unique(flat, return_inverse=True)
        weight = np.tile(counts, 8).astype(np.float64)
        self.ones = np.bincount(at, weight * one, len(self.ids))
        self.zeros = np.bincount(at, weight * ~one, len(self.ids))
        self.own = log_kt(self.zeros, self.ones)
        self.share = np.ones(len(self.ids))
        self.log = self.own

    def weigh(self, children: np.ndarray) -> None:
        """children: log of the product of the children's weighted probabilities, by node."""
        self.log = np.logaddexp(self.own, children) - np.log(2)
        self.share = 1 / (1 + np.exp(np.clip(children - self.own, -700, 700)))

    def parents(self) -> np.ndarray:
        return self.ids >> np.uint64(16) << np.uint64(8) | self.ids & np.uint64(255)

    def under(self, ids: np.ndarray) -> np.ndarray:
        """Sums of log over the children of the nodes named."""
        return np.bincount(np.searchsorted(ids, self.parents()), self.log, len(ids))


def shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same runs with one context byte less."""
    return merged(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), counts)


def deep_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """Nodes of depths DEPTH down to 2, and the runs of depth 1."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    levels: list[Nodes] = []
    for _ in range(DEPTH, 1, -1):
        nodes = Nodes(keys, counts)
        if levels:
            nodes.weigh(levels[-1].under(nodes.ids))
        levels.append(nodes)
        keys, counts = shorter(keys, counts)
    return levels, keys, counts


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a part: its runs with their training counts, and what depth 1 needs of it."""
    blobs = [unpack(b, np.uint32) for b in frame["payload"]]
    keys, counts = merged(np.concatenate([k for k, _ in blobs]), np.concatenate([c for _, c in blobs]))
    levels, low, low_counts = deep_nodes(keys, counts)
    parents, at = np.unique(levels[-1].parents(), return_inverse=True)
    top = pack(low, low_counts.astype(np.int64)), pack(parents, np.bincount(at, levels[-1].log, len(parents)))
    return pd.DataFrame(
        {"part": [frame["part"].iloc[0]], "runs": [pack(keys, counts.astype(np.int64))], "low": [top[0]], "logs": [top[1]]}
    )


def _top_rows(batches):
    """Depth-1 counts (id below 2^16) and sums of logs (above) as rows that Spark adds up."""
    for batch in batches:
        for low, logs in zip(column(batch, "low").to_pylist(), column(batch, "logs").to_pylist(), strict=True):
            (keys, counts), (ids, values) = unpack(low, np.int64), unpack(logs, np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys, ids + np.uint64(1 << 16)]).astype(np.int64)),
                    pa.array(np.concatenate([counts.astype(np.float64), values])),
                ],
                names=["id", "value"],
            )


def top_nodes(ids: np.ndarray, values: np.ndarray) -> list[Nodes]:
    """Nodes of depths 1 and 0 from the sums over all parts."""
    order = np.argsort(ids)
    ids, values = ids[order].astype(np.uint64), values[order]
    low = ids < 1 << 16
    one = Nodes(ids[low], np.rint(values[low]))
    children = np.zeros(len(one.ids))
    children[np.searchsorted(one.ids, ids[~low] - np.uint64(1 << 16))] = values[~low]
    one.weigh(children)
    root = Nodes(*shorter(ids[low], np.rint(values[low])))
    root.weigh(one.under(root.ids))
    return [one, root]


def run_logs(keys: np.ndarray, levels: list[Nodes]) -> np.ndarray:
    """log10 of the probability of each run's byte after its context; levels from DEPTH to 0."""
    byte = keys & np.uint64(255)
    total = np.zeros(len(keys))
    for j in range(8):
        place = np.uint64(1 << j) | byte >> np.uint64(8 - j)
        one = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        p = np.full(len(keys), 0.5)
        for depth, nodes in zip(range(DEPTH, -1, -1), levels, strict=True):
            if not len(nodes.ids):
                continue
            context = keys >> np.uint64(8 * (DEPTH - depth) + 8) if depth else np.zeros(len(keys), np.uint64)
            own = context << np.uint64(8) | place
            at = np.minimum(np.searchsorted(nodes.ids, own), len(nodes.ids) - 1)
            known = nodes.ids[at] == own
            n0, n1 = nodes.zeros[at], nodes.ones[at]
            kt = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            p = np.where(known, nodes.share[at] * kt + (1 - nodes.share[at]) * p, 0.5)
        total += np.log10(p)
    return total


def _answer_runs(top):
    def run(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"kind": [], "chunk": [], "payload": []})
        keys, counts = unpack(model["runs"].iloc[0], np.int64)
        levels, _, _ = deep_nodes(keys, counts)
        logs = run_logs(keys, [*levels, *top.value]).astype(np.float32)
        rows = []
        for chunk, blob in zip(asked["chunk"], asked["payload"], strict=True):
            own, _ = unpack(blob, np.uint32)
            rows.append((RUNS, chunk, pack(own, logs[np.searchsorted(keys, own)])))
        return pd.DataFrame(rows, columns=["kind", "chunk", "payload"])

    return run


SCORED = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(distinct: int, total: int):
    def run(batches):
        chunk, tables = None, {}
        for batch in batches:
            for kind, own, payload in zip(*(column(batch, c).to_pylist() for c in ("kind", "chunk", "payload")), strict=True):
                if own != chunk:
                    chunk, tables = own, {WORDS: [], RUNS: []}
                if kind != DOCS:
                    tables[kind].append(unpack(payload, np.int64 if kind == WORDS else np.float32))
                    continue
                for k, found in tables.items():
                    if isinstance(found, list):
                        keys = np.concatenate([x for x, _ in found])
                        order = np.argsort(keys)
                        tables[k] = keys[order], np.concatenate([v for _, v in found])[order]
                for docs in pa.ipc.open_stream(payload):
                    yield _score(docs, tables, distinct, total)

    return run


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return table[1][np.searchsorted(table[0], distinct)][inverse]


def _score(docs: pa.RecordBatch, tables: dict, distinct: int, total: int) -> pa.RecordBatch:
    data, offsets = text_bytes(column(docs, "text"))
    words, word_begins = doc_words(data, offsets)
    count = _looked_up(words, tables[WORDS])
    base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
    keys, begins = runs(data, offsets)
    logs = _looked_up(keys, tables[RUNS]).astype(np.float64)
    return pa.RecordBatch.from_arrays(
        [
            column(docs, "doc_id"),
            column(docs, "training"),
            pa.array(np.diff(word_begins), pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), word_begins[:-1]), pa.int64()),
            pa.array(np.add.reduceat(base, word_begins[:-1])),
            pa.array(np.add.reduceat(logs, begins[:-1])),
        ],
        names=["doc_id", "training", "n_tokens", "n_known", "base_score", "score"],
    )


def score_texts(docs: DataFrame, training: Column, key="doc_id", text="text") -> DataFrame:
    """Per document: doc_id, training, n_tokens, n_known, train_tokens, base_score and score (log10).
    ``training`` says which documents are learned from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    parts = partitions(spark)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training")
    )
    chunks = scratch.write(rows.mapInArrow(_chunked(parts), CHUNKS), by="kind")
    of = lambda kind: chunks.filter(F.col("kind") == kind)
    words = scratch.write(
        of(WORDS).groupBy("part").applyInPandas(
            _answer_words, "kind int, chunk long, payload binary, distinct long, total long"
        )
    )
    distinct, total = words.filter("chunk < 0").agg(F.sum("distinct"), F.sum("total")).first()
    model = scratch.write(
        of(RUNS).groupBy("part").applyInPandas(_summed, "part int, runs binary, low binary, logs binary")
    )
    top = model.select("low", "logs").mapInArrow(_top_rows, "id long, value double")
    top = top.groupBy("id").agg(F.sum("value").alias("value")).toPandas()  # at most 2^17 rows
    shared = spark.sparkContext.broadcast(top_nodes(top["id"].to_numpy(), top["value"].to_numpy()))
    answers = (
        model.select("part", "runs").groupBy("part")
        .cogroup(of(RUNS).select("part", "chunk", "payload").groupBy("part"))
        .applyInPandas(_answer_runs(shared), "kind int, chunk long, payload binary")
    )
    every = (
        answers.unionByName(words.filter("chunk >= 0").select("kind", "chunk", "payload"))
        .unionByName(of(DOCS).select("kind", "chunk", "payload"))
    )
    met = every.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    scored = met.mapInArrow(_scored(int(distinct or 0), int(total or 0)), SCORED)
    return scored.withColumn("train_tokens", F.lit(int(total or 0)).cast("long"))
