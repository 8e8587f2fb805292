"""Best-fit packing of tokenised documents into sequences of a fixed length.

Linear grouping: large lengths are rounded up to the greatest of their equal-cardinality
group, a linear program over the few sizes left (column generation) says how often each
configuration is used, the actual documents take the rounded places, and the small ones
go best-fit into what stays free.

All of that works on the histogram of lengths, which has at most ``capacity`` rows however
large the corpus is; documents are numbered within their length in parallel and look up
their place by (length, number).

Edge cases: null text is empty and packs as its end token alone; texts beyond the capacity
are cut into pieces and nothing else is; repeated rows are packed as often as they come;
an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column, slices, text_bytes, word_hashes, word_spans

SLICE = 1 << 20
CACHED_WORDS = 1_000_000
CACHED_PARTS = 100_000


# How the vocabulary splits lower-cased Latin-1 text, and what may take this path.
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]+")
_LETTER, _DIGIT = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")


def _byte_letters() -> dict[int, int]:
    """What byte-level vocabularies write for each byte: itself if it prints, else a letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of words, each encoded once. Words may be encoded alone because the
    vocabulary's splitting never reaches over white space. Latin-1 words are split here
    and handed to the vocabulary's merges; all others take the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model
        self._letters = _byte_letters()
        self._clear()

    def _clear(self):
        # Sorted hashes of the words known, and the place of each.
        self._keys, self._places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._parts: dict[str, tuple[int, ...]] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._begins = np.zeros(1 << 16, np.int64)
        self._sizes = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _part(self, part: str) -> tuple[int, ...]:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        return tuple([t.id for t in self._merges.tokenize(written)])

    def word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            parts = [word.lower()]
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            parts = _SPLIT.findall(word.lower())
        else:
            return self._tokenizer.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part in parts:
            ids = self._parts.get(part)
            if ids is None:
                ids = self._part(part)
                if len(self._parts) < CACHED_PARTS:
                    self._parts[part] = ids
            out += ids
        return out

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        found = list(map(self.word, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        first, n = len(self._keys), len(sizes)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while first + n > len(self._begins):
            self._begins = np.concatenate([self._begins, np.zeros_like(self._begins)])
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._sizes[first : first + n] = sizes
        self._begins[first : first + n] = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        self._keys = np.concatenate([self._keys, keys])
        self._places = np.concatenate([self._places, np.arange(first, first + n)])
        order = np.argsort(self._keys)
        self._keys, self._places = self._keys[order], self._places[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each begins."""
        starts, ends, per_text = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        keys, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._keys) + len(keys) > CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self._keys, keys)
        new = np.flatnonzero(np.append(self._keys, np.uint64(0))[at] != keys) if len(self._keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            begin, end = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._add(keys[new], [raw[b:e].decode("utf-8", "replace") for b, e in zip(begin, end, strict=True)])
            at = np.searchsorted(self._keys, keys)
        places = self._places[at][inverse]
        sizes = self._sizes[places]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(self._begins[places] - (stops - sizes), sizes)
        return self._ids[at], np.concatenate([[0], stops])[per_text]


_tokens: dict[str, WordTokens] = {}

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("bucket", pa.int64()),
        ("number", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket long, number long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        tokens = _tokens.setdefault(path, None) or WordTokens(path)
        _tokens[path] = tokens
        bucket = TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, SLICE):
            ids, begins = tokens.encode(*text_bytes(column(batch, "text")))
            rows = []
            for doc, lo, hi in zip(column(batch, "doc_id").to_pylist(), begins[:-1], begins[1:], strict=True):
                own = np.append(ids[lo:hi], end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), bucket, numbers[len(part)]))
                    numbers[len(part)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES
            )

    return run


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations of ``sizes`` and how often the linear program uses each (Gilmore and Gomory)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(60 * k):
        inverse = np.linalg.inv(basis)
        price = inverse.T @ np.ones(k)
        best = np.zeros(capacity + 1)
        pick = np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            value = best[c - sizes[fits]] + price[fits]
            top = int(np.argmax(value))
            if value[top] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[top], fits[top]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-9:
            break
        entering, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                entering[pick[c]] += 1
                c -= sizes[pick[c]]
        amounts, direction = inverse @ demand, inverse @ entering
        ratio = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = entering
    amounts = np.maximum(np.linalg.inv(basis) @ demand, 0)
    return [(basis[:, j].astype(int), float(amounts[j])) for j in range(k)]


def _after(items: list, taken: int) -> list:
    """The items of a run without its first ``taken`` bins."""
    return [(length, first + taken) for length, first in items]


class _Bins:
    """Runs of equal bins by free space: (count, [(length, first number)])."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free: dict[int, list] = defaultdict(list)
        self.order: list[int] = []

    def add(self, free: int, count: int, items: list) -> None:
        if count:
            if not self.free[free]:
                bisect.insort(self.order, free)
            self.free[free].append((count, items))

    def pop(self, length: int):
        """A run with the least free space that holds ``length``."""
        i = bisect.bisect_left(self.order, length)
        if i == len(self.order):
            return None
        free = self.order[i]
        run = self.free[free].pop()
        if not self.free[free]:
            self.order.pop(i)
        return free, *run

    def best_fit(self, length: int, first: int, n: int) -> None:
        """Put numbers first..first+n-1 of a length into the tightest bins, new ones if none holds them."""
        while n:
            found = self.pop(length)
            if found is None:
                each = self.capacity // length
                found = self.capacity, max(1, n // each), []
            free, count, items = found
            each = min(free // length, n)
            filled = min(count, n // each)
            self.add(free, count - filled, _after(items, filled))
            for _ in range(each):
                items = [*items, (length, first)]
                first += filled
            n -= filled * each
            self.add(free - each * length, filled, items)


def packing_plan(histogram: np.ndarray, groups: int = 24, smalls=(2, 3, 4)) -> dict[str, np.ndarray]:
    """The best of the plans with lengths over capacity / 2, / 3 and / 4 as the large ones.

    The more lengths are large, the more space rounding leaves to the small ones; which
    bound needs the fewest sequences depends on how much small text there is to fill it.
    """
    return min((_plan(histogram, groups, s) for s in smalls), key=lambda plan: plan["sequences"])


def _plan(histogram: np.ndarray, groups: int, small: int) -> dict[str, np.ndarray]:
    """Places by length and number: rows (length, first, n, sequence, offset), sorted by length and first.

    Numbers first..first+n-1 of a length go to sequences sequence..sequence+n-1 at offset.
    ``histogram[l]`` counts the pieces of length l; the last index is the capacity.
    Lengths over capacity / ``small`` count as large.
    """
    capacity = len(histogram) - 1
    bins = _Bins(capacity)
    taken = np.zeros(capacity + 1, np.int64)
    bins.add(0, int(histogram[capacity]), [(capacity, 0)])
    large = [l for l in range(capacity - 1, capacity // small, -1) if histogram[l]]
    total = int(sum(histogram[l] for l in large))
    if total:
        cut, seen, members = max(1, -(-total // groups)), 0, defaultdict(list)
        for l in large:  # a length belongs to the group of its first piece
            members[seen // cut].append(l)
            seen += int(histogram[l])
        streams = list(members.values())
        sizes = np.array([s[0] for s in streams])
        demand = np.array([float(sum(histogram[l] for l in s)) for s in streams])
        for shape, amount in configurations(sizes, demand, capacity):
            runs = [(int(amount + 1e-6), capacity, [])]
            for group in np.repeat(np.arange(len(shape)), shape):
                after = []
                for count, free, items in runs:
                    for l in streams[group]:
                        n = min(count, int(histogram[l] - taken[l]))
                        if n:
                            after.append((n, free - l, [*items, (l, int(taken[l]))]))
                            taken[l] += n
                            count -= n
                            items = _after(items, n)
                        if not count:
                            break
                    if count:
                        after.append((count, free, items))
                runs = after
            for count, free, items in runs:
                if items:
                    bins.add(free, count, items)
    for l in range(capacity - 1, 0, -1):
        if histogram[l] > taken[l]:
            bins.best_fit(l, int(taken[l]), int(histogram[l] - taken[l]))
    rows, sequence = [], 0
    for free in bins.order:
        for count, items in bins.free[free]:
            offset = 0
            for l, first in items:
                rows.append((l, first, count, sequence, offset))
                offset += l
            sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "n", "sequence", "offset"), table.T, strict=True)) | {"sequences": sequence}


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.write(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES_DDL))
    counts = scratch.write(pieces.groupBy("bucket", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[row["length"]] = row["n"]
    plan = packing_plan(histogram)
    plan.pop("sequences")
    # Plan rows sort by (length, first): one key for both, as numbers stay below 2^44.
    order = (plan["length"] << 44) + plan["first"]

    def place(batches):
        for batch in batches:
            length, number = (column(batch, c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(order, (length << 44) + number, "right") - 1
            sequence = plan["sequence"][at] + number - plan["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(plan["offset"][at], pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(
        counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    ranked = pieces.join(offsets, ["bucket", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
