"""Many texts that are nearly alike cost rows in proportion to their number, not to that of their pairs."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from pathledger.llm import lines, setjoin
from pathledger.llm.scratch import Scratch
from tests.llm.conftest import smallest_reached


def made(rnd, n, size, most):
    """Texts of one base of ``size`` words, each with up to ``most`` of them changed."""
    base = [f"w{i}" for i in range(size)]
    texts = []
    for i in range(n):
        own = list(base)
        for at in rnd.sample(range(size), rnd.randrange(1, most + 1)):
            own[at] = f"x{i}at{at}"
        texts.append(own)
    return texts


def linked_pairs(sets, percent=80):
    return [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]


def test_a_group_of_near_copies_yields_a_spanning_forest():
    rnd = random.Random(3)
    sets = [set(map(hash, zip(t, t[1:], t[2:], t[3:], strict=False))) for t in made(rnd, 60, 150, 6)]
    arrays = [np.sort(np.array(list(s), np.int64).view(np.uint64)) for s in sets]
    groups = np.arange(60)
    groups[30:40] = 30
    found = setjoin.forest(np.arange(60), groups, arrays, 80)
    pairs = linked_pairs(sets)
    same = [(30, i) for i in range(31, 40)]
    assert set(found) <= {p for a, b in pairs for p in ((a, b), (b, a))} and len(found) < 51 < len(pairs)
    assert smallest_reached(range(60), [*found, *same]) == smallest_reached(range(60), [*pairs, *same])


def test_near_copies_that_hardly_link_are_no_pairs(spark, monkeypatch):
    """Their sketches allow nearly all pairs, and few link: none is a row of its own. Only the result's table stays."""
    rnd = random.Random(11)
    texts = [" ".join(t) for t in made(rnd, 120, 150, 4)]
    written, places, write = [], [], Scratch.write

    def counted(self, frame, *args, **options):
        out = write(self, frame, *args, **options)
        written.append(out.count())
        places.append(self.path)
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rows = setjoin.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4, trees=2).collect()
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    expected = smallest_reached(range(120), linked_pairs(sets))
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert max(written) <= 8 * 120
    assert len(os.listdir(places[-1].removeprefix("file:"))) == 1


def test_a_later_line_is_one_row_however_many_come_before(spark):
    texts = [f"a line of some length {i}" for i in range(9)]
    rows = spark.createDataFrame([(i, t, t, True, 1) for i, t in enumerate(texts)], "first long, line string, rest string, found boolean, key long")
    assert sorted(r.first for r in lines._after(rows, rows, 1).collect()) == list(range(1, 9))
    pivot = rows.filter(F.col("first") == 4)
    assert sorted(r.first for r in lines._later(pivot, rows, 1).collect()) == list(range(4, 9))
