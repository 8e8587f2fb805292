"""The registered queries, and the pipeline stage by stage."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from pathledger.llm import lines
from pathledger.llm.lines import dedup_lines
from pathledger.llm.oracles import ORACLES
from pathledger.llm.queries import QUERIES
from pathledger.llm.scratch import Scratch
from tests.llm.conftest import words
from tests.llm.test_operators import changed, edits

TESTDATA = "/root/testdata/sf0.001"


def test_registration():
    assert set(QUERIES) <= set(contract.queries())
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    names = sorted(d[0] for d in cursor.description)
    expected = cursor.df()[names].sort_values(names).reset_index(drop=True)
    got = QUERIES[name](spark, TESTDATA).toPandas()
    assert sorted(got.columns) == names
    assert got[names].sort_values(names).reset_index(drop=True).equals(expected)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    scratch, before = Scratch(spark, "test"), None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, TESTDATA))
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count()
        if name in ("toxicity", "line dedup", "near dedup"):
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
            assert docs.count() > 0.7 * before.count()
        if name == "near dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name == "mixing":
            taken = sum(len(words(r.text)) for r in docs.collect())
            total = sum(len(words(r.text)) for r in before.collect())
            assert abs(taken - 1.5 * total) < 0.15 * total
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert docs.filter("piece = 0").count() == before.count()


def test_lines_two_edits_apart_are_removed(spark, tmp_path):
    line = "the quick brown fox jumps over the lazy dog " * 7
    other = line[:20] + "#" + line[21:200] + "#" + line[201:]
    docs = spark.createDataFrame([(1, f"{line}\nfirst", 0), (2, f"{other}\nsecond", 0)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: f"{line}\nfirst", 2: "second"}
    removed = {r.doc_id: r.n_removed for r in QUERIES["op4_lines_two"](spark, str(tmp_path)).collect()}
    assert removed == {1: 0, 2: 1}


def test_crowded_lines_two_edits_apart(spark):
    """Fine keys, which lines meet under that share a segment with many others."""
    rnd = random.Random(5)
    texts = [changed(rnd, "abcdefghijklmnopqrstuvwxyz" * 2, 2) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs, max_edits=2, crowded=0).collect()}
    assert got == {i: int(any(edits(t, s) <= 2 for s in texts[:i])) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k", [1, 2])
def test_lines_of_one_template_cost_rows_in_proportion(spark, monkeypatch, k):
    """Lines that differ in a number alone part by its digits; none is compared with all others."""
    written, write = [], Scratch.write

    def counted(self, frame, *args, **options):
        out = write(self, frame, *args, **options)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    cost = []
    for n in (100, 400):
        written.clear()
        numbers = [f"{i * 7919 % 1000003:07d}" for i in range(n)]
        lines = [f"This is the license line and the record number {x} of the archive run" for x in numbers]
        got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), max_edits=k).collect()}
        assert got == {i: int(any(edits(t, s) <= k for s in numbers[:i])) for i, t in enumerate(numbers)}
        cost.append(sum(written))
    assert cost[1] < 6 * cost[0]


def test_lines_keep_columns_of_any_name(spark):
    rows = [(1, "the same line of text\nanother", "a", "b", 5, "c"), (2, "the same line of text", "a", "b", 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, row string, n_removed int, `a.b` string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "gone", "row", "a.b", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], "a", "b", "c", 2, 0), (2, "", "a", "b", "c", 1, 1)]


def test_texts_of_one_id_keep_one_of_a_shared_line(spark):
    docs = spark.createDataFrame([(1, "a line of some length\nx"), (1, "a line of some length\ny")], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_lines(docs).collect()) == [0, 1]


def test_plans_of_line_comparisons_stay_small(spark):
    """The driver keeps plans of many steps, so cuts and comparisons are written once in each."""
    rows = spark.createDataFrame([(1, "a line")], "first long, line string")
    rows = rows.select("first", "line", F.col("line").alias("rest"), F.lit(True).alias("found"))
    size = lambda frame: len(frame._jdf.queryExecution().toString())
    members = lines._members(rows, 2, 0)
    assert size(members) < 20_000
    stored = members.localCheckpoint()
    assert size(lines._later(stored, stored.filter("found"), 2)) < 60_000
