"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over words is trained from confirmed toxic documents and
unlabelled text. The risk is pi * R+(1) + max(0, R-(unlabelled) - pi * R-(positive)) with
logistic loss and class prior pi; where the bracket is negative, the step goes the other
way, so that the classifier can't win by fitting positives as negatives.

Positives and unlabelled texts for training are bounded samples in the order of a hash of
the key; the bounds are parameters. Scores cover every whole text.

Edge cases: null and empty texts score the base rate; documents without a label are
unlabelled text; a document counts as positive if any of its labels says so; with no
positives at all, every score is 0; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column, slices, text_bytes, lower_ascii, word_hashes, word_spans

SLICE = 2 << 20

# Words end at every ASCII byte that is no letter.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(65, 91), *range(97, 123)]] = False


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words before each text."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets, _BREAK)
    return word_hashes(data, starts, ends), before


def _distinct(batches):
    """Distinct words of each text, for the training sample."""
    for batch in slices(batches, SLICE):
        words, before = _words(column(batch, "text"))
        own = [np.unique(words[a:b]).view(np.int64) for a, b in zip(before[:-1], before[1:], strict=True)]
        flat = np.concatenate([*own, np.zeros(0, np.int64)])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([column(batch, "positive"), words], names=["positive", "words"])


@dataclass
class ToxicModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, before = _words(texts)
        out = np.full(len(texts), self.bias)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            text = np.searchsorted(before, hit, "right") - 1
            # A word counts once in a text, as in training.
            pairs = np.unique(text * len(self.words) + at[hit])
            np.add.at(out, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -500, 500))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_documents=8, min_strength=5.0,
          max_words=50_000) -> ToxicModel:
    """The model of distinct words of texts at hand; ``fit_toxicity`` counts them on the executors."""
    if not positive or not unlabelled or prior <= 0:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    texts = [*positive, *unlabelled]
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).view(np.uint64)
    words, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    seen_p = np.bincount(inverse[: sizes[: len(positive)].sum()], minlength=len(words))
    strength = word_strength(seen_p, counts - seen_p, len(positive), len(unlabelled), np)
    keep = np.flatnonzero((counts >= min_documents) & (strength >= min_strength))
    keep = np.sort(keep[np.argsort(-strength[keep], kind="stable")[:max_words]])
    index = np.full(len(words), -1)
    index[keep] = np.arange(len(keep))
    row, col = np.repeat(np.arange(len(texts)), sizes), index[inverse]
    return descend(row[col >= 0], col[col >= 0], np.arange(len(texts)) < len(positive), words[keep], prior)


def word_strength(seen_p, seen_u, n_p, n_u, by):
    """By how many standard errors a word's share of texts differs between both samples.

    Of numpy arrays or of columns; ``by`` is the module with their functions.
    """
    share = (seen_p + seen_u) / (n_p + n_u)
    spread = by.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return by.abs(seen_p / n_p - seen_u / n_u) / (by.maximum(spread, 1e-12) if by is np else by.greatest(spread, by.lit(1e-12)))


def descend(row: np.ndarray, col: np.ndarray, is_p: np.ndarray, words: np.ndarray, prior: float,
            rounds=500, rate=0.05, penalty=1e-5) -> ToxicModel:
    """Non-negative risk, full batches, Adam steps, over pairs of (text, word)."""
    n_p, n_u, n = int(is_p.sum()), int((~is_p).sum()), len(is_p)
    bias = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    theta = np.zeros(len(words) + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(row, theta[col], n) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss_as_negative = np.logaddexp(0, z)
        bracket = loss_as_negative[~is_p].mean() - prior * loss_as_negative[is_p].mean()
        # Slopes of the loss: as positive p - 1, as negative p.
        slope = np.zeros(n)
        if bracket >= 0:
            slope[is_p] = prior / n_p * (p[is_p] - 1) - prior / n_p * p[is_p]
            slope[~is_p] = p[~is_p] / n_u
        else:
            slope[is_p] = prior / n_p * p[is_p]
            slope[~is_p] = -p[~is_p] / n_u
        gradient = np.append(np.bincount(col, slope[row], len(words)), slope.sum())
        gradient[:-1] += penalty * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    # The intercept is set so that the unlabelled texts' mean score is the prior.
    z = np.bincount(row, theta[col], n)[~is_p]
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(z + middle, -500, 500)))).mean() < prior:
            low = middle
        else:
            high = middle
    return ToxicModel(words, theta[:-1], (low + high) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic",
                 max_positive: int = 4000, max_unlabelled: int = 12000, min_documents: int = 8,
                 min_strength: float = 5.0, max_words: int = 50_000) -> ToxicModel:
    """Train from the documents given; labels that shall not be learned must be left out by the caller.

    The prior is the labelled rows' share of positives. Both samples are the first rows by a
    hash of the key, at most ``max_positive`` and ``max_unlabelled`` of them. Words are
    counted on the executors; the driver gets the strongest ``max_words`` of them, and for
    every text the numbers of those it holds, as flat arrays.
    """
    marks = labels.filter(f"{label} IS NOT NULL").groupBy(F.col(key).cast("long").alias("k")).agg(
        (F.max(label) > 0).alias("toxic")
    )
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    keys = docs.select(F.col(key).cast("long").alias("k")).filter("k IS NOT NULL").distinct()
    order = F.xxhash64("k", F.lit("sample"))
    positive = keys.join(marks.filter("toxic"), "k", "left_semi").orderBy(order).limit(max_positive)
    unlabelled = keys.orderBy(order).limit(max_unlabelled)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    sample = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(chosen, "k")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(sample.select("positive", "text").mapInArrow(_distinct, "positive boolean, words array<long>"))
    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    prior = float(share or 0.0)
    if not n_p or not n_u or prior <= 0:
        return ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    counts = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    strength = word_strength(F.col("p"), F.col("u"), n_p, n_u, F)
    strong = counts.select("word", (F.col("p") + F.col("u")).alias("n"), strength.alias("strength")).filter(
        (F.col("n") >= min_documents) & (F.col("strength") >= min_strength)
    )
    chosen = strong.orderBy(F.desc("strength"), "word").limit(max_words).select("word").toArrow()
    words = np.sort(chosen.column("word").to_numpy().view(np.uint64))
    flat = rows.mapInArrow(_numbered(words), "positive boolean, words array<int>").toArrow()
    lists = flat.column("words").combine_chunks()
    col = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return descend(row, col, flat.column("positive").to_numpy().astype(bool), words, prior)


def _numbered(words: np.ndarray):
    """For each text, the numbers of the chosen words that it holds."""

    def run(batches):
        for batch in batches:
            lists = column(batch, "words")
            flat = lists.flatten().to_numpy().view(np.uint64)
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.searchsorted(words, flat)
            known = np.flatnonzero(at < len(words))
            known = known[words[at[known]] == flat[known]]
            cuts = np.searchsorted(text[known], np.arange(len(lists) + 1))
            numbers = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[known], pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "positive"), numbers], names=["positive", "words"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel, text="text", score="score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1. The model has at most its 50,000 words' size."""
    columns = [c for c in docs.columns if c != score]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(score, F.lit(0.0)).schema

    def run(batches):
        for batch in slices(batches, SLICE, text):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.scores(column(batch, text)), pa.float64())],
                names=[*batch.schema.names, score],
            )

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
