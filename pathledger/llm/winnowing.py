"""Benchmark decontamination by winnowing.

A window is a run of words of a benchmark item. Of the hashes of all k words in a row, each
window keeps the least one: its fingerprint. Documents keep the least hash of every stretch
of that length, so that a window that occurs in a document has the same fingerprint there:
no shared span of a window's length is missed. Fingerprints that training and test share
are extended to the windows around them, which are joined by fingerprint and hash of the
whole window; what matches is a hit.

The join is on distinct windows, so a pair of texts never meets twice, and documents send
one row for each window of a chunk of texts, however often it occurs there: passages that a
third of all documents hold cost one row a chunk. Before it, a bitmap of fixed size over the
benchmark's hashes keeps out most of what can't match; as the benchmark grows it lets more
through and nothing else changes. Windows that lie in the same items share one set of items,
and documents that hit the same sets share one list.

Words are told apart by 64-bit hashes, windows by those of the whole and of the fingerprint.

Edge cases: null and empty texts have no words, hit nothing and are returned; items without
words have no window; items shorter than a window are one window of all their words; items
of equal id count as one, without id as one of the id ''; documents of equal or null id are
rows of their own; very long texts are chunks of their own; an empty benchmark leaves all
documents clean; other columns of both tables are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column, gram_hashes, lower_ascii, slices, span_hashes, text_bytes, word_hashes, word_spans

WINDOW = 10
GRAM = 5
CHUNK_BYTES = 4 << 20
BITS, BLOCK = 27, 16  # the bitmap: 16 MB, built in blocks of 8 kB

# Bytes of words after A-Z became a-z; all others end a word.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = False
GAP[0x80:] = False


def hashed_words(texts: pa.Array):
    """Hashes of all words, and the number of words before each text."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets, GAP)
    return word_hashes(data, starts, ends), before


def fingerprints(words: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` words, the least hash of the grams in it."""
    gram = min(GRAM, span)
    grams = gram_hashes(words, gram)
    count = max(0, len(words) - span + 1)
    least = grams[:count].copy()
    for shift in range(1, span - gram + 1):
        np.minimum(least, grams[shift : shift + count], out=least)
    return least


def inside(before: np.ndarray, span: int, count: int) -> np.ndarray:
    """Which of the first ``count`` positions begin a run of ``span`` words within one text."""
    ends = np.repeat(before[1:], np.diff(before))[:count]
    return np.arange(count) + span <= ends


def _bits(marks: np.ndarray, spans: np.ndarray):
    mask = np.uint64((1 << BITS) - 1)
    return marks & mask, (spans >> np.uint64(30)) & mask


def _item_windows(window: int):
    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            words, before = hashed_words(column(batch, "text"))
            items = column(batch, "item")
            counts = np.diff(before)
            for span in np.unique(np.minimum(counts, window)):
                if not span:
                    continue
                marks = fingerprints(words, int(span))
                fits = inside(before, int(span), len(marks))
                owner = np.repeat(np.arange(len(counts)), counts)[: len(marks)]
                at = np.flatnonzero(fits & (np.minimum(counts, window)[owner] == span))
                yield pa.RecordBatch.from_pydict({
                    "item": items.take(pa.array(owner[at])),
                    "span": pa.array(np.full(len(at), span, np.int32)),
                    "mark": pa.array(marks[at].view(np.int64)),
                    "whole": pa.array(span_hashes(words, at, at + span).view(np.int64)),
                })

    return run


def _bitmap(windows: DataFrame) -> bytes:
    """A bit for every fingerprint and window of the benchmark; 16 MB whatever their number."""
    spark = windows.sparkSession

    def marked(batches):
        for batch in batches:
            marks, wholes = (column(batch, c).to_numpy().view(np.uint64) for c in ("mark", "whole"))
            bits = np.unique(np.concatenate(_bits(marks, wholes)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"block": pa.array((bits >> BLOCK).astype(np.int32)), "bit": pa.array(bits)})

    def packed(frame):
        block = np.zeros(1 << BLOCK, bool)
        block[frame["bit"].to_numpy() & ((1 << BLOCK) - 1)] = True
        return frame.iloc[:1][["block"]].assign(bits=[np.packbits(block, bitorder="little").tobytes()])

    bits = windows.select("mark", "whole").mapInArrow(marked, "block int, bit long").distinct()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (BLOCK - 3)
    for row in bits.groupBy("block").applyInPandas(packed, "block int, bits binary").collect():
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


_CHUNK = (
    "chunk string, ids array<long>, before array<long>, "
    "spans array<int>, marks array<long>, wholes array<long>, ends array<int>, places binary"
)


def _candidates(spans: list[int], bitmap):
    """One row a chunk: its documents, the distinct windows that may be the benchmark's, and where they begin."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)

        def known(at):
            return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in slices(batches, CHUNK_BYTES):
            words, before = hashed_words(column(batch, "text"))
            found = []
            for span in spans:
                marks = fingerprints(words, span)
                at = np.flatnonzero(known(_bits(marks, marks)[0]) & inside(before, span, len(marks)))
                wholes = span_hashes(words, at, at + span)
                sure = known(_bits(wholes, wholes)[1])
                at, wholes = at[sure], wholes[sure]
                order = np.lexsort((at, marks[at], wholes))
                found.append((np.full(len(at), span, np.int32), marks[at][order], wholes[order], at[order]))
            span, marks, wholes, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            new = np.ones(len(at), bool)
            new[1:] = (span[1:] != span[:-1]) | (marks[1:] != marks[:-1]) | (wholes[1:] != wholes[:-1])
            first = np.flatnonzero(new)
            lists = {
                "ids": (column(batch, "id").to_pylist(), pa.int64()),
                "before": (before, pa.int64()),
                "spans": (span[first], pa.int32()),
                "marks": (marks[first].astype(np.uint64).view(np.int64), pa.int64()),
                "wholes": (wholes[first].astype(np.uint64).view(np.int64), pa.int64()),
                "ends": (np.append(first, len(at))[1:] if len(first) else first, pa.int32()),
            }
            yield pa.RecordBatch.from_pydict({
                "chunk": [uuid.uuid4().hex],
                **{name: pa.array([v], pa.list_(kind)) for name, (v, kind) in lists.items()},
                "places": [at.astype(np.int32).tobytes()],
            })

    return run


_HITS = "doc_id long, n_words long, n_hit long, sets array<long>"


def _hits(batches):
    """Words hit and sets of items of every document of a chunk, from its windows that matched."""
    for batch in batches:
        for row in batch.to_pylist():
            before = np.array(row["before"], np.int64)
            n = len(before) - 1
            ends = np.concatenate([[0], np.array(row["ends"], np.int64)])
            places = np.frombuffer(row["places"], np.int32).astype(np.int64)
            matched = row["matched"] or []
            depth = np.zeros(before[-1] + 1, np.int64)
            owners, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for match in matched:
                at = places[ends[match["number"]] : ends[match["number"] + 1]]
                np.add.at(depth, at, 1)
                np.add.at(depth, at + row["spans"][match["number"]], -1)
                owner = np.unique(np.searchsorted(before, at, "right") - 1)
                owners.append(owner)
                sets.append(np.full(len(owner), match["items"], np.int64))
            covered = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
            pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(sets)], 1), axis=0)
            cuts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["ids"], pa.int64()),
                "n_words": pa.array(np.diff(before)),
                "n_hit": pa.array(np.diff(covered[before])),
                "sets": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pairs[:, 1])),
            })


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    window_key = ["span", "mark", "whole"]
    named = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")
    )
    raw = scratch.write(
        named.mapInArrow(_item_windows(window), "item string, span int, mark long, whole long").distinct()
    )
    # Windows of equal sets of items share the number of their set.
    windows = scratch.write(
        raw.groupBy(*window_key)
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b"))
        .select(*window_key, F.xxhash64("n", "a", "b").alias("items"))
    )
    shown = windows.groupBy("items").agg(F.min(F.struct(*window_key)).alias("w")).select("items", "w.*")
    listed = raw.join(shown, window_key).select("items", "item")
    spans = sorted(r.span for r in windows.select("span").distinct().collect())

    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chunks = scratch.write(given.mapInArrow(_candidates(spans, _bitmap(windows)), _CHUNK))
    asked = chunks.select(
        "chunk", F.posexplode(F.arrays_zip(F.col("spans").alias("span"), F.col("marks").alias("mark"), F.col("wholes").alias("whole")))
    ).select("chunk", F.col("pos").alias("number"), "col.*")
    matched = (
        asked.join(windows, window_key)
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("number", "items")).alias("matched"))
    )
    hits = scratch.write(
        chunks.select("chunk", "ids", "before", "spans", "ends", "places")
        .join(matched, "chunk", "left")
        .mapInArrow(_hits, _HITS)
        .withColumn("profile", F.when(F.size("sets") > 0, F.xxhash64("sets")))
    )
    profiles = hits.filter("profile IS NOT NULL").groupBy("profile").agg(F.first("sets").alias("sets"))
    items = (
        profiles.select("profile", F.explode("sets").alias("items"))
        .join(listed, "items")
        .select("profile", "item")
        .distinct()
        .groupBy("profile")
        .agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    hit = hits.filter("profile IS NOT NULL").join(items, "profile")
    clean = hits.filter("profile IS NULL").withColumns(
        {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    )
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    rows = hit.select(*columns).unionByName(clean.select(*columns))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without any hit, columns as given; all rows of an id go with one that is hit."""
    found = contamination(docs, benchmark, key, **options)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("__hit_id")).distinct()
    return docs.join(bad, F.col(key).cast("long").eqNullSafe(F.col("__hit_id")), "left_anti")
