"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams, fitted on a bounded sample of labelled
texts and kept in sorted arrays of n-gram keys. A text gets the language with the least
cross-entropy per character. A text whose entropy lies above what held-out texts of its
language show (mean plus four deviations), or that has no letter, is rejected. Scores are
a softmax over -temperature * entropy, with the temperature that makes held-out texts of
the sample likeliest.

Edge cases: null texts and texts without letters are ``und`` with score 0; rows without a
language are not learned from; without any labelled row everything is ``und``; equal
entropies go to the first language by code point; repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.text import column, slices

SLICE = 1 << 20
ORDER = 5
BITS = 12  # of a character in an n-gram's key; characters from 4096 on share codes
UNKNOWN = "und"


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts, white space as one code, with ORDER - 1 marks before each text; and where each begins."""
    pad = "\x02" * (ORDER - 1)
    texts = [pad + (t or "").lower() for t in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(flat < 1 << BITS, flat, flat % 1021 + 3000).astype(np.uint64)
    codes[(flat >= 9) & (flat <= 13)] = 32
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-gram that ends at each character, and where each text's begin."""
    codes, begins = _codes(texts)
    keys = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        keys <<= np.uint64(BITS)
        keys[back:] |= codes[: len(codes) - back]
    real = np.ones(len(codes), bool)
    for back in range(ORDER - 1):
        real[begins[:-1] + back] = False
    return keys[real], begins - np.arange(len(begins)) * (ORDER - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class CharModel:
    """Interpolated Kneser-Ney: counts at the highest order, continuation counts below it."""

    def __init__(self, texts: list[str]):
        top, _ = _grams(texts)
        keys, counts = np.unique(top, return_counts=True)
        self.levels = []  # from the highest order down: n-grams, discounted shares, contexts, weights of the lower order
        for order in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, inverse = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(inverse, counts)
            kinds = np.bincount(inverse)
            self.levels.append(
                (keys, (counts - discount) / total[inverse], contexts, discount * kinds / total)
            )
            shorter = keys & np.uint64((1 << (BITS * (order - 1))) - 1)
            keys, counts = np.unique(shorter, return_counts=True)

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 2.0**BITS)
        for i, (grams, share, contexts, weight) in enumerate(reversed(self.levels)):
            mask = np.uint64((1 << (BITS * (i + 1))) - 1)
            own = keys & mask
            at, context = _find(grams, own), _find(contexts, own >> np.uint64(BITS))
            p = np.where(context >= 0, np.where(at >= 0, share[at], 0) + weight[context] * p, p)
        return p


@dataclass
class LanguageModel:
    languages: list[str]
    models: list[CharModel]
    limits: np.ndarray  # entropy per character above which a text is rejected
    temperature: float

    def __post_init__(self):
        self._keys = np.zeros(0, np.uint64)
        self._logs = np.zeros((0, len(self.models)), np.float32)

    def _log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """-log2 p of n-grams in every language; those seen before are looked up."""
        at = _find(self._keys, keys)
        new = keys[at < 0]
        out = np.empty((len(keys), len(self.models)), np.float32)
        out[at >= 0] = self._logs[at[at >= 0]]
        if len(new):
            found = np.stack([-np.log2(m.probabilities(new)) for m in self.models], 1).astype(np.float32)
            out[at < 0] = found
            if len(self._keys) < 1 << 20:
                self._keys = np.concatenate([self._keys, new])
                order = np.argsort(self._keys)
                self._keys = self._keys[order]
                self._logs = np.concatenate([self._logs, found])[order]
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits per character of each text in each language; 0 for empty texts."""
        keys, begins = _grams(texts)
        if not len(keys):
            return np.zeros((len(texts), len(self.models)))
        distinct, inverse = np.unique(keys, return_inverse=True)
        logs = self._log_probabilities(distinct)
        sizes = np.diff(begins)
        full = np.flatnonzero(sizes)
        out = np.zeros((len(texts), len(self.models)))
        for i in range(len(self.models)):
            out[full, i] = np.add.reduceat(logs[inverse, i].astype(np.float64), begins[full]) / sizes[full]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected."""
        letters = np.array([any(map(str.isalpha, t)) if t else False for t in texts], bool)
        if not self.models:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits = self.entropies(texts)
        best = np.argmin(bits, 1)
        share = np.exp2(-self.temperature * (bits - bits.min(1, keepdims=True)))
        score = np.where(letters, 1 / share.sum(1), 0.0)
        rejected = ~letters | (bits.min(1) > self.limits[best])
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, rejected


def fit_languages(docs: DataFrame, key="doc_id", text="text", lang="lang", per_language: int = 400,
                  characters: int = 1_500_000) -> LanguageModel:
    """Fit from the documents given, at most ``per_language`` of each language by a hash of the key.

    Models are trained in tasks, one per language. Of a language's sample, whole texts are
    used until ``characters`` of them are reached; every fifth is held out for calibration.
    """
    place = F.xxhash64("k", F.lit("lang"))
    order = Window.partitionBy("lang").orderBy(place, "k")
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    # One row per language. Of a large one, hashes leave about twice what is needed before any exchange.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if counts:
        shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(2.0 * per_language / n + 100 / n))])
        rows = rows.filter(F.pmod(place, F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))
    sample = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        frame = frame.sort_values("n")
        before = frame["text"].str.len().cumsum().shift(fill_value=0)
        frame = frame[before < characters]
        held = frame["n"] % 5 == 0 if len(frame) >= 5 else frame["n"] < 0
        model = CharModel(frame.loc[~held, "text"].tolist())
        texts = frame.loc[held if held.any() else ~held, "text"].tolist()
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "model": [pickle.dumps((model, texts), 5)]})

    import pickle

    found = sorted(sample.groupBy("lang").applyInPandas(learn, "lang string, model binary").collect())
    languages = [r["lang"] for r in found]
    parts = [pickle.loads(r["model"]) for r in found]
    model = LanguageModel(languages, [m for m, _ in parts], np.full(len(parts), np.inf), 1.0)
    if not parts:
        return model
    bits = [model.entropies([t for t in texts if t]) for _, texts in parts]
    model.limits = np.array(
        [b[:, i].mean() + 4 * b[:, i].std() if len(b) > 1 else np.inf for i, b in enumerate(bits)]
    )
    truth = np.concatenate([np.full(len(b), i) for i, b in enumerate(bits)])
    every = np.concatenate(bits)

    def likelihood(t: float) -> float:
        z = -t * (every - every.min(1, keepdims=True))
        return float((z[np.arange(len(truth)), truth] - np.log2(np.exp2(z).sum(1))).sum())

    model.temperature = max((2.0**k for k in range(-2, 7)), key=likelihood)
    model.__post_init__()
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text="text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected. The broadcast model is bounded by its sample."""
    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in names]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        local = spread.value
        for batch in slices(batches, SLICE, text):
            langs, score, rejected = local.predict(column(batch, text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                names=[*batch.schema.names, *names],
            )

    return base.mapInArrow(run, schema)
