"""Each operator against a plain version of itself, and on odd input."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathledger.llm.ann import nearest
from pathledger.llm.ctw import DEPTH, score_texts
from pathledger.llm.embeddings import near_duplicate_vectors, possible, quantise
from pathledger.llm.fmindex import FMIndex
from pathledger.llm.langid import CharModel, fit_languages, identify_languages
from pathledger.llm.lines import dedup_lines, within_edits
from pathledger.llm.mixing import mix_sources, mixing_plan
from pathledger.llm.packing import WordTokens, pack_documents, packing_plan
from pathledger.llm.queries import tokenizer_path
from pathledger.llm.setjoin import _against_all, drop_near_duplicates, near_duplicates
from pathledger.llm.substring import remove_repeated
from pathledger.llm.text import text_bytes, word_hashes, word_spans
from pathledger.llm.toxicity import fit_toxicity, score_toxicity, train
from tests.llm.conftest import lower, smallest_reached, words

LETTERS = "abcdefghij"


def made_up(rnd, n):
    return " ".join("".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(2, 6))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(result):
    return {r.doc_id: r for r in result.collect()}


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", None, " x\x0b\x1cy ", "Ä ö\tß", "b a"]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, before = word_spans(data, offsets)
    raw = data.tobytes()
    found = [[raw[starts[i] : ends[i]].decode() for i in range(a, b)] for a, b in zip(before[:-1], before[1:])]
    assert found == [words(t) for t in texts]
    hashes = word_hashes(data, starts, ends)
    same = {}
    for i, key in enumerate(hashes.tolist()):
        assert same.setdefault(raw[starts[i] : ends[i]], key) == key
    assert len(set(same.values())) == len(same)


# -- substring dedup ---------------------------------------------------------------


def test_fm_index_finds_longest_matches():
    rnd = random.Random(5)
    texts = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 40))] for _ in range(12)]
    asked = [[rnd.randrange(5) for _ in range(30)] for _ in range(6)]
    begins = np.cumsum([0] + [len(t) for t in texts])
    index = FMIndex(np.array(sum(texts, [])), begins, 6)
    flat = np.array(sum(asked, []))
    length, low, high = index.matching_statistics(index.symbols(flat), np.arange(0, 181, 30))
    runs = {n: {} for n in range(1, 7)}
    for t in texts:
        for i in range(len(t)):
            for n in range(1, min(6, len(t) - i) + 1):
                run = tuple(t[i : i + n])
                runs[n][run] = runs[n].get(run, 0) + 1
    at = 0
    for q in asked:
        for i in range(30):
            best = max((n for n in range(1, min(6, 30 - i) + 1) if tuple(q[i : i + n]) in runs[n]), default=0)
            assert length[at] == best
            if best:
                assert high[at] - low[at] == runs[best][tuple(q[i : i + best])]
            at += 1


def covered(texts, window):
    seen, out = {}, []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.setdefault(key, True)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup(spark, hot):
    rnd = random.Random(1)
    passage = made_up(rnd, 30)
    texts = [made_up(rnd, rnd.randrange(5, 60)) for _ in range(25)]
    texts += [f"{made_up(rnd, 7)} {passage}\n{made_up(rnd, 9)}" for _ in range(10)]
    texts += [texts[3], texts[4] + "  more", "a b c " * 40, "x " * 700, made_up(rnd, 21), None, "", passage]
    got = by_id(remove_repeated(frame(spark, texts), hot=hot))
    expected = covered(texts, 20)
    assert [(got[i].n_words, got[i].n_removed, got[i].text) for i in range(len(texts))] == expected
    for i, r in got.items():
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed


# -- packing -----------------------------------------------------------------------


def test_words_that_share_half_a_hash_differ(spark):
    """Two words whose hashes agree in the upper 32 bits, at the end of otherwise equal documents."""
    names = [f"w{i}" for i in range(400_000)]
    data = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([len(n) for n in names])
    upper = word_hashes(data, ends - [len(n) for n in names], ends) >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    i = int(np.flatnonzero(upper[order][1:] == upper[order][:-1])[0])
    one, two = names[order[i]], names[order[i + 1]]
    texts = []
    for n in range(10):
        filler = " ".join(f"f{n}x{j}" for j in range(19))
        texts += [f"{filler} {one}", f"{filler} {two}"]
    got = remove_repeated(frame(spark, texts), window=20).collect()
    assert len(got) == 20 and all(r.n_removed == 0 for r in got)


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack_documents(documents, tokenizer_path(), capacity=256).collect()
    ids = {}
    for r in documents.collect():
        own = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(own), 256)):
            ids[r.doc_id, piece] = own[start : start + 256]
    assert {(r.doc_id, r.piece) for r in rows} == ids.keys() and len(rows) == len(ids)
    places = {}
    for r in rows:
        part = ids[r.doc_id, r.piece]
        assert (r.start, r.length) == (256 * r.piece, len(part))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 256
    assert len(places) <= 1.02 * sum(map(len, ids.values())) / 256 + 1


def test_words_are_encoded_as_the_tokenizer_does():
    own = WordTokens(tokenizer_path())
    for text in ["it's I'll <|endoftext|> x", "Ünḯ ½ 12a ſ İ 漢字 é­b", "a b \x85 \x1cq"]:
        ids, _ = own.encode(*text_bytes(pa.array([text])))
        assert ids.tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_number_once(seed):
    rnd = np.random.default_rng(seed)
    histogram = np.zeros(101, np.int64)
    for length in rnd.integers(1, 101, 15 * 4**seed):
        histogram[length] += 1
    plan = packing_plan(histogram)
    used = np.zeros(plan["sequences"], np.int64)
    for length, first, n, sequence, _ in zip(*(plan[c] for c in ("length", "first", "n", "sequence", "offset"))):
        used[sequence : sequence + n] += length
    for length in range(1, 101):
        own = plan["length"] == length
        firsts, ns = plan["first"][own], plan["n"][own]
        assert firsts.tolist() == (np.cumsum(ns) - ns).tolist() and ns.sum() == histogram[length]
    assert used.max() <= 100 and used.min() > 0


# -- embeddings --------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, size int")


def test_error_bounds_hold():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 24)) * rnd.exponential(size=(200, 24)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = quantise(x)
    exact = x @ x.T
    for threshold in (0.1, 0.5, 0.9):
        assert possible(q, q, threshold)[exact >= threshold].all()


@pytest.mark.parametrize("tile", [1024, 4])
def test_embedding_near_duplicates(spark, tile):
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(6, 8))
    rows = []
    for i in range(60):
        v = centers[i % 6] + rnd.normal(size=8) * rnd.choice([0.0, 0.1, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 6 > 2), 0))
    rows += [(60, None, 0, 0), (61, [0.0] * 8, 0, 0), (62, [1.0, None] * 4, 0, 0), (63, [float("nan")] * 8, 0, 0)]
    rows += [(64, rows[0][1], None, 0), (65, [float("inf")] * 8, 0, 0), (66, [], 1, 0), (67, rows[3][1][:4], 1, 0)]
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, rows), tile=tile).collect()}
    x = np.array([r[1] for r in rows[:60]], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:60]])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    component = smallest_reached(range(68), zip(*np.nonzero(link)))
    assert len(got) == 68 and link.any()
    for i in range(68):
        expected = (int(link[i].sum()) if i < 60 else 0, component[i], component[i] == i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == expected


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 12)).astype(np.float32)
    x[7] = x[9] = x[200]
    rows = [(i, [float(a) for a in v], 0, 0) for i, v in enumerate(x)]
    bad = [(900, None, 0, 0), (1000, [0.0] * 12, 0, 0), (1100, [float("nan")] * 12, 0, 0)]
    table = vectors(spark, rows + bad)
    got = nearest(table, table.filter("vec_id % 100 = 0"), k=10, block=50).collect()
    hits = 0
    for q in (0, 100, 200):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        distance = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        assert all(r.score == pytest.approx(distance[r.vec_id], abs=1e-12) for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        best = sorted(set(range(300)) - {q}, key=lambda i: (distance[i], i))[:10]
        hits += len({r.vec_id for r in own} & set(best))
        if q == 200:
            assert [r.vec_id for r in own[:2]] == [7, 9]
    assert len(got) == 30 and hits >= 27
    few = vectors(spark, rows[:4])
    assert nearest(few, few.filter("vec_id = 0"), probes=1, tables=1).count() == 3


# -- lines -------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def changed(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(len(text) + 1)
        text = rnd.choice([text[:i] + "é" + text[i:], text[:i] + text[i + 1 :], text[:i] + "b" + text[i + 1 :]])
    return text


def test_banded_edit_distance(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(150):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.randrange(0, 14)))
        pairs.append((a, changed(rnd, a, rnd.randrange(4))))
    table = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2):
        for r in table.select("a", "b", within_edits(F.col("a"), F.col("b"), k).alias("near")).collect():
            assert r.near == (edits(r.a, r.b) <= k), (r.a, r.b, k)


@pytest.mark.parametrize("k, crowded", [(1, 16), (2, 16), (1, 0)])
def test_line_dedup(spark, k, crowded):
    rnd = random.Random(k)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(0, 26))) for _ in range(25)]
    texts = ["\n".join(changed(rnd, rnd.choice(base), rnd.randrange(3)) for _ in range(rnd.randrange(1, 5))) for _ in range(50)]
    got = by_id(dedup_lines(frame(spark, texts), max_edits=k, min_chars=10, crowded=crowded))
    seen = []
    for i, text in enumerate(texts):
        kept = []
        for line in text.split("\n"):
            near = any(line == s or (min(len(line), len(s)) >= 10 and edits(line, s) <= k) for s in seen)
            if not (line.strip(" ") and near):
                kept.append(line)
            seen.append(line)
        assert (got[i].text, got[i].n_lines) == ("\n".join(kept), text.count("\n") + 1)


# -- sets --------------------------------------------------------------------------


@pytest.mark.parametrize("node, levels, chunk", [(64, 8, 512), (4, 3, 512), (4, 3, 2), (3, 0, 512), (3, 0, 5)])
def test_set_join(spark, node, levels, chunk):
    rnd = random.Random(7)
    texts = []
    for _ in range(6):
        base = made_up(rnd, 60).split()
        for _ in range(9):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(60)] = "zz"
            texts.append(" ".join(own).upper() if rnd.random() < 0.3 else " ".join(own))
    texts += ["one two", "ONE  two", "one", None, "", made_up(rnd, 4)]
    got = by_id(near_duplicates(frame(spark, texts), size=4, node=node, levels=levels, chunk=chunk))
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()})
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    component = smallest_reached(range(len(sets)), links)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), component[i], component[i] == i)


# -- mixing ------------------------------------------------------------------------


def test_blocks_of_very_large_nodes(spark):
    """From 2,148 blocks on their pairs' numbers pass 32 bits."""
    rows = spark.range(50).selectExpr("0L AS key", "id AS rep", "200000 AS n", "40 + 3000 AS others", "id < 40 AS other", "id AS comp", "id AS tag")
    blocks = {}
    for r in _against_all(rows, 64).select("rep", "block").collect():
        blocks.setdefault(r.rep, set()).add(r.block)
    # Every member outside the largest component meets every other one in some block.
    assert all(blocks[a] & blocks[b] for a in range(40) for b in range(50))
    assert max(max(b) for b in blocks.values()) > 1 << 32
    assert {len(blocks[b]) for b in range(40, 50)} == {48} and max(len(b) for b in blocks.values()) <= 48 + 3125


def test_mixing_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, made_up(rnd, rnd.randrange(1, 30)), rnd.choice(["a", "b", "c", None])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing_plan(table).collect()
    total = sum(r["size"] for r in plan)
    targets = {r.source: r.target for r in plan}
    sizes = {r.source: r.source_size for r in plan}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for source, target in targets.items():
        taken = sum(r.taken for r in plan if r.source == source)
        assert target <= 2 * sizes[source] + 1e-6 and abs(taken - target) <= 0.03 * target
    assert all(r.taken <= 2 * r["size"] for r in plan)
    mixed = mix_sources(table).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in plan if r.copies}


# -- models ------------------------------------------------------------------------


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 10 == 0
        text = made_up(rnd, 30) + (" " + " ".join(rnd.sample(["vile", "foul", "nasty"], 2)) + "!" if bad else "")
        rows.append((i, text))
        if i % 3 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs.filter("doc_id % 2 = 0"), marks.filter("doc_id % 2 = 0"))
    scored = score_toxicity(docs.filter("doc_id % 2 = 1 OR doc_id % 20 = 10"), model).collect()
    wrong = [r for r in scored if (r.score >= 0.3) != (r.doc_id % 10 == 0)]
    assert len(wrong) <= 0.02 * len(scored)
    assert train([], [np.zeros(0, np.int64)], 0.1).scores(pa.array(["x", None])).max() == 0


def test_language_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs.filter("doc_id % 4 <> 2"), per_language=60)
    rows = identify_languages(docs.filter("doc_id % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    own = CharModel(["abab abab abba"])
    codes = np.arange(1 << 12, dtype=np.uint64)
    context = sum(np.uint64(ord(c)) << np.uint64(12 * (4 - i)) for i, c in enumerate("abab"))
    assert own.probabilities(context | codes).sum() == pytest.approx(1)


def plain_tree(training, depth):
    """Context-tree weighting by its definition: a dictionary of nodes, and log probabilities by recursion."""
    counts = {}
    for text in training:
        data = bytes(depth) + text.encode() + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                prefix = 1 << j | data[i] >> (8 - j)
                bit = data[i] >> (7 - j) & 1
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], prefix), [0, 0])[bit] += 1

    def own(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted = {}

    def log(context, prefix):
        key = context, prefix
        if key not in counts:
            return 0.0
        if key not in weighted:
            if len(context) == depth:
                weighted[key] = own(counts[key]), 1.0
            else:
                below = sum(log(bytes([b]) + context, prefix) for b in range(256))
                a = own(counts[key])
                weighted[key] = np.logaddexp(a, below) - math.log(2), 1 / (1 + math.exp(below - a))
        return weighted[key][0]

    def score(text):
        data, total = bytes(depth) + text.encode() + b"\0", 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                prefix, bit, p = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1, 0.5
                for d in range(depth, -1, -1):
                    key = data[i - d : i], prefix
                    if key in counts:
                        log(*key)
                        n, share = counts[key], weighted[key][1]
                        p = share * (n[bit] + 0.5) / (sum(n) + 1) + (1 - share) * p
                    else:
                        p = 0.5
                total += math.log10(p)
        return total

    return score


def test_scores(spark):
    texts = ["the cat the cat", "a cat sat", "The dog", None, "", "über the cat", "cat " * 20]
    training = [0, 1, 3, 5, 6]
    got = by_id(score_texts(frame(spark, texts), F.col("doc_id").isin(training)))
    counts, total = {}, 0
    for i in training:
        for w in [*words(lower(texts[i])), None]:
            counts[w] = counts.get(w, 0) + 1
            total += 1
    tree = plain_tree([texts[i] or "" for i in training], DEPTH)
    for i, t in enumerate(texts):
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(tree(t or ""), rel=1e-5)
        assert r.training == (i in training)


# -- odd input ---------------------------------------------------------------------


def test_odd_documents(spark, odd):
    n = odd.count()
    kept = {r.doc_id: r for r in remove_repeated(odd).collect()}
    assert kept[5].n_words == 30_000 and kept[5].n_removed == 29_999 and kept[4].n_removed == 0
    assert kept[1].n_words == kept[2].n_words == 0
    packed = pack_documents(odd, tokenizer_path())
    assert packed.agg(F.sum("length")).first()[0] > 30_000
    assert packed.filter("doc_id = 1").first().length == 1
    assert dedup_lines(odd).count() == n and dedup_lines(odd).filter("doc_id = 1").first().text is None
    joined = near_duplicates(odd).collect()
    assert len(joined) == n and {r.component_id for r in joined if r.doc_id == 4} == {4}
    assert drop_near_duplicates(odd).count() == n
    plan = mixing_plan(odd).collect()
    assert len(plan) == n and {r["size"] for r in plan if r.doc_id in (1, 2, 3)} == {0}
    assert set(mix_sources(odd).columns) == set(odd.columns)
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    scored = score_toxicity(odd, fit_toxicity(odd, labels)).collect()
    assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    found = identify_languages(odd, fit_languages(odd)).collect()
    assert len(found) == n and {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    scores = score_texts(odd, F.lit(True)).collect()
    assert len(scores) == n and all(r.score <= 0 for r in scores)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    no_vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    results = [
        remove_repeated(none), pack_documents(none, tokenizer_path()), dedup_lines(none), near_duplicates(none),
        mixing_plan(none), mix_sources(none), score_toxicity(none, fit_toxicity(none, no_labels)),
        identify_languages(none, fit_languages(none)), score_texts(none, F.lit(True)),
        near_duplicate_vectors(no_vectors), nearest(no_vectors, no_vectors),
    ]
    assert [r.count() for r in results] == [0] * len(results)
