"""Source divergence, whitening and decontamination against plain versions of themselves."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pathledger.llm import divergence
from pathledger.llm.divergence import source_divergence
from pathledger.llm.oracles import OP11, OP13
from pathledger.llm.perfecthash import PerfectHash, TermShard, same_bytes, term_hashes
from pathledger.llm.text import text_bytes
from pathledger.llm.whitening import bidiagonalise, fit_whitening, whiten, whole
from pathledger.llm.winnowing import contamination, decontaminate, fingerprints
from tests.llm.conftest import lower


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def by_sql(text, **tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        pandas = frame.toPandas()  # noqa: F841 - read by the next line
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM pandas")
    return connection.execute(text)


# -- perfect hashes ------------------------------------------------------------------


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(1 << 63, size=20_000, dtype=np.uint64)
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(20_000))
    assert PerfectHash.build(np.array([5, 6, 5], np.uint64)) is None
    assert len(PerfectHash.build(np.zeros(0, np.uint64)).slots(keys)) == 20_000


def test_terms_are_verified():
    terms = [f"term{i}".encode() for i in range(500)]
    shard = TermShard(*TermShard.build(terms).values())
    asked = terms[::-1] + [b"other%d" % i for i in range(500)] + [b"t"]
    ends = np.cumsum([len(t) for t in asked])
    data, starts = np.frombuffer(b"".join(asked), np.uint8), np.concatenate([[0], ends[:-1]])
    slots = shard.slots(data, starts, ends, term_hashes(data, starts, ends))
    stored = shard.terms.tobytes()
    assert [stored[shard.starts[s] : shard.ends[s]] for s in slots[:500]] == asked[:500]
    assert (slots[500:] == -1).all()
    assert same_bytes(data, starts, ends, data, starts, ends).all()


# -- source divergence ---------------------------------------------------------------


def plain_divergence(rows):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(term.findall(lower(t)), l or "", s or "") for _, t, l, s, *_ in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(w, s) for w, l, s in docs if l == lang]
        kept = sorted({t for w, _ in mine for t in w if sum(t in v for v, _ in mine) >= 3})
        sources = sorted({s for _, s in mine})

        def shares(chosen):
            counts = {t: sum(w.count(t) for w, s in mine if s in chosen) for t in kept}
            total = sum(counts.values()) + len(kept)
            return counts, {t: 1 + 1000000000 * (n + 1) // total for t, n in counts.items()}

        _, whole_share = shares(sources)
        for source in sources:
            counts, p = shares([source])
            pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()) for o in sources if o != source for q in [shares([o])[1]]]
            terms = [(-((p[t] - q) ** 2 // q), t.encode()) for t, q in whole_share.items() if counts[t] and p[t] > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, source, part, i.decode(), -v, n) for n, (v, i) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdéß漢" for b in "uvwxyzÄ"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(60))).title() + rnd.choice(["", "-7.", "\x00", "'"]) for _ in range(60)]
    rows = [(i % 50, t, rnd.choice(["en", "de", None, "en"]), rnd.choice(["a", "b", None, "c", "é", "", "Z"])) for i, t in enumerate(texts)]
    rows += [(90, None, "xx", "a"), (91, "", "xx", "b"), (None, "7 8 !", "yy", None), (92, "alone " * 20_000, "zz", "q")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_plain(mixed, monkeypatch, small):
    rows, frame = mixed
    if small:  # several shards, passes, blocks of slots and tiles of sources
        for name, value in {"SHARD_TERMS": 8, "BROADCAST_BYTES": 600, "SLOT_BLOCK": 5, "SOURCE_TILE": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    assert rows_of(source_divergence(frame)) == plain_divergence(rows)


def _texts(n, size, terms):
    rnd = random.Random(9)
    spell = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    texts = [" ".join(spell(rnd.randrange(terms)) for _ in range(size)) for _ in range(n)]
    return pa.RecordBatch.from_pydict({"text": texts, "lang": [("en", "de")[i % 2] for i in range(n)]})


def test_divergence_counts_in_bounded_memory():
    """Two tasks of one executor count beside its heap: arrays over a slice of text stay small."""
    batch = _texts(200, 5_000, 20_000)
    tracemalloc.start()
    try:
        for _ in divergence._document_counts([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20


@pytest.mark.parametrize("held", [50, 2000, 1 << 20])
def test_divergence_adds_up_what_a_task_holds(monkeypatch, held):
    """Terms of several slices are added up when a task holds many, and handed on when they stay many."""
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    batch, got, expected = _texts(60, 40, 300), Counter(), Counter()
    out = list(divergence._document_counts([batch]))
    for row in (r for b in out for r in b.to_pylist()):
        got[row["lang"], row["term"]] += row["n"]
    for text, lang in zip(*batch.to_pydict().values()):
        expected.update((lang, t) for t in set(text.split()))
    assert got == expected and (len(out) > 2) == (held == 50)


def test_divergence_of_odd_rows(spark, odd):
    expected = plain_divergence([(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()])
    assert rows_of(source_divergence(odd)) == expected
    got = by_sql(OP11, documents=odd)
    order = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(got.df()[order].itertuples(index=False, name=None), key=repr) == expected
    assert source_divergence(odd.filter("false")).collect() == []
    assert source_divergence(odd.filter("doc_id = 2")).collect() == []


# -- whitening -----------------------------------------------------------------------


def check_whitening(spark, vectors, expected_components, fitted=None):
    fitted = range(len(vectors)) if fitted is None else fitted
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string")
    got = whiten(frame).toPandas()
    x = np.stack([whole(np.array(vectors[i])) for i in fitted])
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1][:expected_components], axes[:, ::-1][:, :expected_components]
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(table.index) == list(fitted) and list(table.columns) == list(range(1, expected_components + 1))
    expected = centred @ axes / np.sqrt(values)
    assert np.abs(np.abs((table.to_numpy() * expected).mean(0)) - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values / (centred**2).sum() * len(x), rtol=1e-10)
    exact = {i: sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for i, r in zip(fitted, x)}
    assert {(r.vec_id, r.deviation) for r in got.itertuples()} == set(exact.items())
    assert (got.n == len(x)).all()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    check_whitening(spark, (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)).tolist(), 8)


def test_whitening_of_low_rank_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    # Multiples of 1/1024 keep the rank through the rounding.
    flat = (rng.integers(-40, 40, (50, 3)) @ np.eye(3, 9, dtype=int) / 1024).tolist()
    odd = [None, [], [0.0] * 9, [1.0, None] + [0.0] * 7, [float("nan")] * 9, [float("inf")] + [0.0] * 8, [1.0] * 4, [1e300] * 9]
    check_whitening(spark, flat + odd, 3, [*range(50), 52])


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]):
        assert whiten(spark.createDataFrame(vectors, schema)).collect() == []
    assert fit_whitening(spark.createDataFrame([], schema)) is None
    twice = whiten(spark.createDataFrame([(None, [0.0]), (None, [0.0]), (3, [1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in twice) == [(0, 1, 3), (0, 1, 3), (3, 1, 3)]


def test_bidiagonalisation_finds_repeated_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 10)))
    r, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    values = np.array([5, 5, 5, 2, 2, 1, 1, 0, 0, 0.0])
    x = q * values @ r.T

    def product(direction, left):
        p = x @ direction
        return np.concatenate([x.T @ p, (x @ left).T @ p, [p @ p]])

    right, matrix = bidiagonalise(product, 10, 8)
    assert np.allclose(right @ right.T, np.eye(len(right)))
    found = np.linalg.svd(matrix, compute_uv=False)
    assert np.allclose(found[:7], values[:7]) and (found[7:] < 1e-9).all()


# -- decontamination -----------------------------------------------------------------


def plain_contamination(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        w = word.findall(lower(text))
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if (run := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[run]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_fingerprints_are_the_least_grams_of_windows():
    words = np.random.default_rng(1).integers(1 << 63, size=60, dtype=np.uint64)
    marks = fingerprints(words, 10)
    assert len(marks) == 51
    for at in (0, 7, 50):
        assert marks[at] == fingerprints(words[at : at + 10], 10)[0]


def test_contamination_equals_plain(spark):
    rnd = random.Random(6)
    made = lambda n: [rnd.choice("ab") + rnd.choice("cdé") for _ in range(n)]
    items = [(i, " ".join(made(rnd.randrange(0, 14)))) for i in range(12)]
    passage = "The shared passage, of more than ten WORDS: lies in 40 texts and 9 items!"
    items += [(100 + i, f"{' '.join(made(3))} {passage}") for i in range(9)] + [(None, passage), (5, passage), (6, None), (7, "..."), (8, "one")]
    docs = [(i, " ".join(made(rnd.randrange(0, 40)))) for i in range(40)]
    docs += [(200 + i, f"{i} {passage.upper()}; {' '.join(made(i % 7))}") for i in range(40)]
    docs += [(1, None), (None, "one"), (2, ""), (3, "nothing to see here " * 9000), (3, passage[:-9])]
    expected = plain_contamination(docs, items)
    assert {r[3] for r in expected} >= {0, 1, 11}
    schemas = "doc_id long, text string, n_hit string", "item_id long, text string, span string"
    frame = spark.createDataFrame([(*d, "x") for d in docs], schemas[0]).repartition(5)
    benchmark = spark.createDataFrame([(*i, "x") for i in items], schemas[1])
    assert rows_of(contamination(frame, benchmark)) == expected
    bad = {r[0] for r in expected if r[5]}
    kept = decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted((r[0] or -1 for r in kept.collect())) == sorted(d[0] or -1 for d in docs if d[0] not in bad)


def test_contamination_of_odd_and_empty_tables(spark, odd):
    benchmark = spark.createDataFrame([(1, "one TWO three"), (2, "漢字")], "item_id long, text string")
    expected = plain_contamination([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in benchmark.collect()])
    assert rows_of(contamination(odd, benchmark)) == expected
    got = by_sql(OP13, documents=odd.filter("doc_id <> 4"), benchmark=benchmark).df()
    assert sorted(got.n_hit) == sorted(r[2] for r in expected if r[0] not in (4, None))
    clean = contamination(odd, benchmark.filter("false")).collect()
    assert len(clean) == odd.count() and not any(r.contaminated for r in clean)
    assert contamination(odd.filter("false"), benchmark).collect() == []


def test_long_texts_are_chunks_of_their_own(spark):
    text = "w " * 3_000_000
    data, _ = text_bytes(spark.createDataFrame([(text,)], "t string").toArrow().column("t").combine_chunks())
    assert len(data) == 6_000_000
    rows = contamination(
        spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"),
        spark.createDataFrame([(1, "w " * 30)], "item_id long, text string"),
    ).collect()
    assert sorted((r.doc_id, r.n_hit) for r in rows) == [(1, 3_000_000), (2, 0)]
