"""Rows that share an id, or have none, are told apart."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pathledger.llm.setjoin import near_duplicates
from pathledger.llm.substring import remove_repeated
from pathledger.llm.toxicity import fit_toxicity, train
from pathledger.llm.toxicity import _words as toxic_words
from tests.llm.conftest import words


def plain_removed(rows, window=20):
    """Words removed from each row; rows of one id are one document, those without are the last one."""
    last = 1 << 62
    starts = {}
    docs = [((last if i is None else i), words(t)) for i, t in rows]
    for doc, w in docs:
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            starts[run] = min((doc, s), starts.get(run, (last + 1, 0)))
    out = []
    for doc, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if starts[tuple(w[s : s + window])] < (doc, s):
                gone |= set(range(s, s + window))
        out.append(len(gone))
    return out


def unique(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


P = unique("p", 30)


@pytest.mark.parametrize("rows", [
    [(1, P), (None, f"{unique('a', 10)} {P}"), (None, unique("b", 60))],
    [(1, P), (None, f"{unique('a', 10)} {P}"), (None, unique("b", 60)), (None, "one two three")],
    [(1, P), (2, f"{P} {unique('a', 30)}"), (2, unique("b", 60))],
    [(1, P), (5, f"{unique('a', 7)} {P} {unique('c', 9)}"), (5, f"{unique('a', 7)} {P} {unique('c', 9)}"), (5, f"x {P}")],
])
def test_rows_lose_their_own_words_alone(spark, rows):
    for repeat in (1, 3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(repeat)
        got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in remove_repeated(frame).collect())
        expected = sorted((i or -1, len(words(t)), n) for (i, t), n in zip(rows, plain_removed(rows)))
        assert got == expected


def test_words_counted_on_executors_train_the_same_model(spark):
    rnd = random.Random(8)
    common = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    common = [w + "x" for w in common]
    texts = []
    for i in range(400):
        bad = i % 8 == 0
        texts.append((i, " ".join(rnd.choices(common, k=30) + (rnd.choices(["vile", "nasty", "awful"], k=3) if bad else [])), int(bad)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in texts if i % 2 == 0], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    own = {}
    for i, text, _ in texts:
        own[i] = np.unique(toxic_words(pa.array([text]))[0]).view(np.int64)
    marked = [b for i, _, b in texts if i % 2 == 0]
    plain = train([own[i] for i, _, b in texts if b and i % 2 == 0], [own[i] for i, *_ in texts], sum(marked) / len(marked))
    assert len(model.words) and (model.words == plain.words).all()
    assert np.allclose(model.weights, plain.weights, atol=1e-6) and abs(model.bias - plain.bias) < 1e-6


def test_texts_of_one_id_link_for_it(spark):
    """An id with several texts is one document in links, whichever of them links."""
    base = unique("w", 60)
    near = base + " more"
    far = [unique(c, 60) for c in "xyz"]
    cases = [
        ([(1, base), (5, near), (5, far[0])], {1: 1, 5: 1}),
        ([(5, far[0]), (5, near), (1, base), (7, far[0] + " end"), (8, far[1])], {1: 1, 5: 1, 7: 1, 8: 8}),
        ([(2, far[0]), (2, far[1]), (2, far[1]), (3, far[1] + " a"), (4, far[2])], {2: 2, 3: 2, 4: 4}),
        ([(9, far[2]), (9, far[1]), (None, far[1]), (6, None), (6, "")], {9: 9, None: None, 6: 6}),
    ]
    for rows, expected in cases:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = near_duplicates(frame).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == expected
        assert all(expected[r.doc_id] == r.component_id for r in got)
