"""Substring dedup: words covered by a window of words that also starts earlier are removed.

Windows go to shards by their anchor, the least hash of the runs of words within them, so
equal windows meet. Neighbouring windows with one anchor travel as one segment, and only
segments whose anchor occurs again anywhere travel at all. A shard builds FM-indexes over
its distinct segments, each standing for its earliest occurrence, and streams them through
by backward search: matching statistics give every window's range of suffixes, the range
its earliest occurrence, and runs of windows that start earlier elsewhere are reported as
intervals of their documents.

Documents equal to an earlier one need no search. Anchors with very many occurrences are
routed by their whole windows instead, which spreads one common passage over all shards.

Documents travel as compressed blobs in chunks of bounded size; nothing is collected.

Edge cases: null and empty texts have no words; texts with fewer words than a window keep
all of them; rows of one id are one document: of two windows in them only one that starts
at an earlier word counts as earlier, and each row loses its own words alone; documents
without an id count as the last, and as one document; a very long text is one chunk; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm.ctw import merged, pack, unpack
from pathledger.llm.fmindex import FMIndex
from pathledger.llm.scratch import Scratch, partitions
from pathledger.llm.text import column, gram_hashes, mix, slices, span_hashes, text_bytes, word_hashes, word_spans

SLICE = 2 << 20
CHUNK = 24 << 20
PIECE = 256  # windows of a segment at most
INDEX = 1 << 20  # tokens of one index
ANCHORS, TEXTS, FOUND, DOCS = 0, 1, 2, 3
LAST = np.iinfo(np.int64).max
ROWS = "kind int, part int, chunk long, payload binary"


def _row(kind: int, part: int, chunk: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())],
        names=["kind", "part", "chunk", "payload"],
    )


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if len(values) > rest else values[:0]


class Segmented:
    """Words of some texts, and their segments: runs of windows with one anchor."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.data, self.offsets = text_bytes(texts)
        self.starts, self.ends, self.before = word_spans(self.data, self.offsets)
        self.words = word_hashes(self.data, self.starts, self.ends)
        sizes = np.diff(self.before)
        # One hash for all words of a text, to find copies.
        self.copy_keys = span_hashes(self.words, self.before[:-1], self.before[1:])
        grams = gram_hashes(self.words, gram)
        least = sliding_least(grams, window - gram + 1)
        # A window can only occur twice in one segment if some run of words comes again within reach.
        near = np.zeros(len(grams) + 1, np.int64)
        for step in range(1, window - gram + 2):
            near[: max(0, len(grams) - step)] |= grams[:-step] == grams[step:]
        near = np.concatenate([[0], np.cumsum(near[:-1])])
        left = np.repeat(self.before[1:], sizes) - np.arange(len(self.words))  # words from here to the text's end
        at = np.flatnonzero(left[: len(least)] >= window)  # where a window starts
        anchor = least[at]
        text = np.searchsorted(self.before, at, "right") - 1
        fresh = np.ones(len(at), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(fresh)
        inside = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(inside % PIECE == 0)
        self.at, self.text, self.anchor = at[begin], text[begin], anchor[begin]
        self.windows = np.diff(np.append(begin, len(at)))
        self.inner = near[self.at + self.windows + window - gram] > near[self.at]


def _table_of(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "doc_id").fill_null(LAST).to_numpy()


def _by_part(keys: np.ndarray, parts: int):
    part = (mix(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def _chunked(parts: int, window: int, gram: int):
    def flush(chunk, anchors, copies):
        keys, counts = merged(*(np.concatenate(x) for x in zip(*anchors, strict=True)))
        for p, own in _by_part(keys, parts):
            yield _row(ANCHORS, p, chunk, pack(keys[own], counts[own].astype(np.uint32)))
        keys = np.array(sorted(copies), np.uint64)
        first = np.array([copies[k] for k in keys.tolist()], np.int64)
        for p, own in _by_part(keys, parts):
            yield _row(TEXTS, p, chunk, pack(keys[own], first[own]))

    def run(batches):
        chunk, size, rows, anchors, copies = TaskContext.get().partitionId() << 24, 0, 0, [], {}
        for batch in slices(batches, SLICE):
            own = Segmented(column(batch, "text"), window, gram)
            new = np.zeros(batch.num_rows, bool)
            for i, (key, doc) in enumerate(zip(own.copy_keys.tolist(), _ids(batch).tolist(), strict=True)):
                new[i] = key not in copies
                copies[key] = min(doc, copies.get(key, LAST))
            keep = new[own.text]  # copies within a chunk count once
            anchors.append(merged(own.anchor[keep], 1 + own.inner[keep]))
            numbers = pa.array(np.arange(rows, rows + batch.num_rows, dtype=np.int32))
            yield _row(DOCS, -1, chunk, _table_of(batch.append_column("row", numbers)))
            rows += batch.num_rows
            size += len(own.data)
            if size >= CHUNK:
                yield from flush(chunk, anchors, copies)
                chunk, size, rows, anchors, copies = chunk + 1, 0, 0, [], {}
        if anchors:
            yield from flush(chunk, anchors, copies)

    return run


def _answer(hot: int):
    """Which of a chunk's anchors occur more than once in all (1, or 2 if too often for one
    shard), and the first document with a text's words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, group in frame.groupby("kind"):
            blobs = [unpack(b, np.uint32 if kind == ANCHORS else np.int64) for b in group["payload"]]
            flat, values = np.concatenate([k for k, _ in blobs]), np.concatenate([v for _, v in blobs])
            keys, at = np.unique(flat, return_inverse=True)
            if kind == ANCHORS:
                value = np.bincount(at, values, len(keys)).astype(np.int64)
                value = (value > 1).astype(np.int64) + (value > hot)
            else:
                value = np.full(len(keys), LAST)
                np.minimum.at(value, at, values)
            for chunk, (own, _) in zip(group["chunk"], blobs, strict=True):
                answer = value[np.searchsorted(keys, own)]
                use = answer > 0 if kind == ANCHORS else np.ones(len(own), bool)
                rows.append((kind, chunk, pack(own[use], answer[use])))
        return pd.DataFrame(rows, columns=["kind", "chunk", "payload"])

    return run


def _joined(tables: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in tables]])
    values = np.concatenate([np.zeros(0, np.int64), *[v for _, v in tables]])
    order = np.argsort(keys)
    return keys[order], values[order]


def _value(table, keys: np.ndarray) -> np.ndarray:
    """Values of keys, 0 for those that the table lacks."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def _stream(batches):
    """Rows of the tables sorted by chunk and kind: for each blob of documents, its chunk and the answers for it."""
    chunk, tables, ready = None, {}, {}
    for batch in batches:
        for kind, own, payload in zip(*(column(batch, c).to_pylist() for c in ("kind", "chunk", "payload")), strict=True):
            if own != chunk:
                chunk, tables, ready = own, {}, {}
            if kind != DOCS:
                tables.setdefault(kind, []).append(payload)
                continue
            if not ready:
                ready = {
                    k: _joined([unpack(p, np.int64) for p in tables.get(k, [])]) for k in (ANCHORS, TEXTS)
                } | {FOUND: _intervals(tables.get(FOUND, []))}
            for docs in pa.ipc.open_stream(payload):
                yield chunk, docs, ready


# ``row`` is the text's number within its chunk; ``doc``, which texts may share, is for the order alone.
SEGMENT = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4"), ("words", "<i4"), ("inner", "?")])


def _segments(parts: int, window: int, gram: int):
    """Segments whose anchor occurs again, dealt to shards: one blob a chunk and shard."""

    def flush(chunk, heads, words):
        heads, words = np.concatenate(heads), np.concatenate(words)
        begins = np.concatenate([[0], np.cumsum(heads["words"])])
        for p, own in _by_part(heads["anchor"], parts):
            sizes = heads["words"][own]
            stops = np.cumsum(sizes)
            at = np.arange(stops[-1]) + np.repeat(begins[own] - (stops - sizes), sizes)
            yield _row(ANCHORS, p, chunk, np.int64(len(own)).tobytes() + heads[own].tobytes() + words[at].tobytes())

    def run(batches):
        heads, words, now = [], [], None
        for chunk, docs, ready in _stream(batches):
            if now is not None and now != chunk and heads:
                yield from flush(now, heads, words)
                heads, words = [], []
            now = chunk
            own = Segmented(column(docs, "text"), window, gram)
            ids = _ids(docs)
            first = _value(ready[TEXTS], own.copy_keys) == ids
            use = _value(ready[ANCHORS], own.anchor) * first[own.text]
            at, sizes = own.at[use > 0], own.windows[use > 0]
            anchor, text, state, inner = (v[use > 0] for v in (own.anchor, own.text, use, own.inner))
            hot = state > 1
            if hot.any():  # each window on its own, by the hash of all its words
                each = sizes[hot]
                stops = np.cumsum(each)
                spots = np.arange(stops[-1]) + np.repeat(at[hot] - (stops - each), each)
                at = np.concatenate([at[~hot], spots])
                text = np.concatenate([text[~hot], np.repeat(text[hot], each)])
                anchor = np.concatenate([anchor[~hot], span_hashes(own.words, spots, spots + window)])
                sizes = np.concatenate([sizes[~hot], np.ones(len(spots), np.int64)])
                inner = np.concatenate([inner[~hot], np.zeros(len(spots), bool)])
            if not len(at):
                continue
            head = np.zeros(len(at), SEGMENT)
            head["anchor"], head["doc"], head["start"] = anchor, ids[text], at - own.before[text]
            head["words"], head["inner"] = sizes + window - 1, inner
            head["row"] = column(docs, "row").to_numpy()[text]
            stops = np.cumsum(head["words"], dtype=np.int64)
            heads.append(head)
            words.append(own.words[np.arange(stops[-1]) + np.repeat(at - (stops - head["words"]), head["words"])])
        if heads:
            yield from flush(now, heads, words)

    return run


def repeats(heads: np.ndarray, tokens: np.ndarray, window: int) -> np.ndarray:
    """Intervals (row, begin, end in words of the text) of the segments' windows that start
    earlier in a smaller document or the same one. ``heads``: SEGMENT rows, tokens behind one another."""
    sizes = heads["words"].astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    content = span_hashes(tokens, begins[:-1], begins[1:])
    order = np.lexsort((heads["start"], heads["doc"], content))
    lead = np.ones(len(order), bool)
    lead[1:] = content[order][1:] != content[order][:-1]
    owner = order[lead][np.cumsum(lead) - 1]
    later = (heads["doc"][order] != heads["doc"][owner]) | (heads["start"][order] != heads["start"][owner])
    whole = order[later]
    out = [np.stack([whole, heads["start"][whole], heads["start"][whole] + sizes[whole]], 1)]
    # Of the distinct segments, those that share an anchor or hold a run of words twice can repeat.
    own = order[lead]
    own = own[np.argsort(heads["anchor"][own], kind="stable")]
    anchors, group = np.unique(heads["anchor"][own], return_inverse=True)
    crowded = np.bincount(group)[group] > 1
    own = own[crowded | heads["inner"][own]]
    start = 0
    stops = np.cumsum(sizes[own])
    while start < len(own):
        # An index takes whole anchors, up to its size.
        base = stops[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(stops, base + INDEX, "right")))
        while stop < len(own) and heads["anchor"][own[stop]] == heads["anchor"][own[stop - 1]]:
            stop += 1
        out.append(_search(heads, tokens, begins, own[start:stop], window))
        start = stop
    found = np.concatenate(out).astype(np.int64)
    # Rows of one document that hold a segment at one place lose the same words.
    twins = ~later & ~lead
    twin, first = order[twins], owner[twins]
    found = found[np.argsort(found[:, 0], kind="stable")]
    low, high = np.searchsorted(found[:, 0], first), np.searchsorted(found[:, 0], first, "right")
    times = high - low
    at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
    return np.concatenate([found, np.column_stack([np.repeat(twin, times), found[at, 1:]])])


def _search(heads, tokens, begins, own, window) -> np.ndarray:
    sizes = heads["words"][own].astype(np.int64)
    stops = np.cumsum(sizes)
    at = np.arange(stops[-1]) + np.repeat(begins[:-1][own] - (stops - sizes), sizes)
    local = np.concatenate([[0], stops])
    index = FMIndex(tokens[at], local, window)
    length, low, _ = index.matching_statistics(index.symbols(tokens[at]), local)
    # Earliest (document, word) of every suffix's window, by ranges that agree on it.
    segment = np.searchsorted(index.begins, index.order, "right") - 1
    inside = index.order - index.begins[segment]
    doc, word = heads["doc"][own][segment], heads["start"][own][segment] + inside
    by = np.lexsort((word, doc, index.classes))
    lead = by[np.searchsorted(index.classes[by], np.arange(len(index.class_starts) - 1))]
    full = np.flatnonzero(length >= window)
    row = np.searchsorted(local, full, "right") - 1
    here = heads["start"][own][row] + (full - local[row])
    first = lead[index.classes[low[full]]]
    again = (doc[first] != heads["doc"][own][row]) | (word[first] != here)
    full, row, here = full[again], row[again], here[again]
    if not len(full):
        return np.zeros((0, 3), np.int64)
    fresh = np.ones(len(full), bool)
    fresh[1:] = (full[1:] != full[:-1] + 1) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(full)) - 1
    return np.stack([own[row[begin]], here[begin], here[end] + window], 1)


def _shard(window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads, tokens = [], []
        for blob in frame["payload"]:
            n = int(np.frombuffer(blob[:8], np.int64)[0])
            cut = 8 + n * SEGMENT.itemsize
            heads.append(np.frombuffer(blob[8:cut], SEGMENT))
            tokens.append(np.frombuffer(blob[cut:], np.uint64))
        chunk = np.repeat(frame["chunk"].to_numpy(), [len(h) for h in heads])
        heads = np.concatenate(heads)
        found = repeats(heads, np.concatenate(tokens), window)
        rows = []
        home = chunk[found[:, 0]]
        for own in np.unique(home):
            mine = found[home == own]
            rows.append((FOUND, own, np.stack([heads["row"][mine[:, 0]], mine[:, 1], mine[:, 2]], 1).astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["kind", "chunk", "payload"])

    return run


def _intervals(blobs: list[bytes]) -> np.ndarray:
    """(row of the chunk, begin, end) of all blobs, by row."""
    found = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(b, "<i8").reshape(-1, 3) for b in blobs]])
    return found[np.argsort(found[:, 0], kind="stable")]


def _cut(window: int, gram: int):
    """Documents without their repeated words."""

    def run(batches):
        for _, docs, ready in _stream(batches):
            data, offsets = text_bytes(column(docs, "text"))
            starts, ends, before = word_spans(data, offsets)
            words = word_hashes(data, starts, ends)
            copy_keys = span_hashes(words, before[:-1], before[1:])
            ids, sizes = _ids(docs), np.diff(before)
            copies = (_value(ready[TEXTS], copy_keys) != ids) & (sizes >= window)
            change = np.zeros(len(words) + 1, np.int64)
            found = ready[FOUND]
            rows = column(docs, "row").to_numpy()
            lo, hi = np.searchsorted(found[:, 0], rows), np.searchsorted(found[:, 0], rows, "right")
            for i in np.flatnonzero((hi > lo) & ~copies):
                np.add.at(change, before[i] + found[lo[i] : hi[i], 1], 1)
                np.add.at(change, before[i] + found[lo[i] : hi[i], 2], -1)
            gone = np.cumsum(change[:-1]) > 0
            gone |= np.repeat(copies, sizes)
            # Bytes that stay: those of kept words, and one space behind each but a text's last.
            text = np.repeat(np.arange(len(ids)), sizes)
            kept = np.flatnonzero(~gone)
            more = np.zeros(len(kept), bool)
            more[:-1] = text[kept[1:]] == text[kept[:-1]]
            flags = np.zeros(len(data) + 1, np.int8)
            np.add.at(flags, starts[kept], 1)
            np.add.at(flags, ends[kept], -1)
            stay = np.cumsum(flags[:-1], dtype=np.int8) > 0
            out = data.copy()
            out[ends[kept[more]]] = 32
            stay[ends[kept[more]]] = True
            total = np.concatenate([[0], np.cumsum(stay)])[offsets]
            joined = pa.StringArray.from_buffers(
                len(ids), pa.py_buffer(total.astype(np.int32)), pa.py_buffer(out[stay])
            )
            edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
            # Removed intervals, cut where texts meet.
            cut = np.zeros(len(words) + 1, bool)
            cut[before] = True
            opens = np.flatnonzero((edge[:-1] == 1) | (cut[:-1] & gone))
            shuts = np.flatnonzero(((edge[1:] == -1) | cut[1:]) & gone) + 1
            place = np.searchsorted(opens, before)
            home = np.searchsorted(before, opens, "right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(place, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(opens - before[home], pa.int32()), pa.array(shuts - before[home], pa.int32())], ["begin", "end"]
                ),
            )
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [
                    column(docs, "doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.diff(removed[before]), pa.int64()),
                    spans,
                    joined,
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "text"],
            )

    return run


CUT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, text string"


def remove_repeated(docs: DataFrame, key="doc_id", text="text", window: int = 20, gram: int = 8, hot: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (removed words, begin to end), text (kept words).

    Words are judged on the input: a window that is itself removed still counts as earlier.
    ``hot``: from so many occurrences on, an anchor's windows are dealt one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    parts = partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = scratch.write(rows.mapInArrow(_chunked(parts, window, gram), ROWS), by="kind")
    texts = chunks.filter(F.col("kind") == DOCS).select("kind", "chunk", "payload")
    answers = scratch.write(
        chunks.filter(F.col("kind") != DOCS).groupBy("part").applyInPandas(
            _answer(hot), "kind int, chunk long, payload binary"
        ),
        by="kind",
    ).select("kind", "chunk", "payload")

    def by_chunk(extra: DataFrame) -> DataFrame:
        met = texts.unionByName(extra)
        return met.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")

    segments = by_chunk(answers).mapInArrow(_segments(parts, window, gram), ROWS)
    found = segments.groupBy("part").applyInPandas(_shard(window), "kind int, chunk long, payload binary")
    found = scratch.write(found)
    copies = answers.filter(F.col("kind") == TEXTS)
    return by_chunk(found.unionByName(copies)).mapInArrow(_cut(window, gram), CUT)
