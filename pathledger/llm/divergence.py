"""Divergence of the sources of each language by a recount over minimal perfect hashes.

The first pass finds in how many documents of its language a term occurs, exactly: distinct
terms of each document, added up per slice of text and then by a shuffle. Terms in at least
``least`` documents are kept. Tasks build a minimal perfect hash over each shard of the kept
terms of a language, with the terms stored beside it. The second pass reads the documents
with these hashes broadcast, verifies every token against the stored term, and increments
dense slots per (language, source). A broadcast holds at most ``BROADCAST_BYTES`` of shards:
a larger vocabulary takes several passes, each with the next shards.

Sources of a language are compared in tiles: a task holds a block of slots of two tiles of
sources and adds up every pair of them; slots that neither source of a pair fills are
counted instead of visited. All arithmetic is in whole numbers.

Edge cases: null texts, languages and sources count as ''; a text without letters has no
terms, its group is still returned; every row of documents is a document of its own,
whatever its id; repeated rows count as often as they occur; a language without kept terms
has pairs of value 0 and no terms; one source alone has no pairs; very long texts are slices
of their own and terms of any length are kept whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.llm.perfecthash import TermShard, same_bytes, term_hashes
from pathledger.llm.scratch import Scratch
from pathledger.llm.text import column, lower_ascii, slices, text_bytes, word_spans

SLICE_BYTES = 1 << 20  # arrays over a slice take some 80 times its bytes
BROADCAST_BYTES = 64 << 20
HELD_TERMS = 1 << 20  # terms of slices that one task adds up before it hands them on
SLOT_BYTES = 32 << 20  # dense counters, of four bytes, that one task holds before it hands them on
SLOT_TOKENS = 1 << 30  # tokens that it counts before it does so, which no counter can exceed
SHARD_TERMS, SHARD_BYTES = 1 << 17, 4 << 20
SLOT_BLOCK, SOURCE_TILE = 8192, 128

# Bytes of terms after A-Z became a-z; all others end a term.
GAP = np.ones(256, bool)
GAP[0x61:0x7B] = False
GAP[0x80:] = False


def _tokens(batch: pa.RecordBatch):
    """Bytes, spans and hashes of terms, the texts they are from, and the numbers and names of the texts' languages."""
    data, offsets = text_bytes(column(batch, "text"))
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets, GAP)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(before))
    langs = column(batch, "lang").dictionary_encode()
    return data, starts, ends, term_hashes(data, starts, ends), owner, langs.indices.to_numpy(), langs.dictionary.to_pylist()


def _distinct(data, starts, ends, hashes):
    """A number for each different term among spans, and a span of each."""
    number, keys = pd.factorize(hashes)
    first = np.empty(len(keys), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    back = first[number]
    if not same_bytes(data, starts, ends, data, starts[back], ends[back]).all():
        raw = data.tobytes()
        terms = pd.Series([raw[a:b] for a, b in zip(starts, ends)])
        number, _ = pd.factorize(terms)
        first = np.flatnonzero(~terms.duplicated().to_numpy())
    return number, first


def _strings(data, starts, ends) -> pa.Array:
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    flat = data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])


def _document_counts(batches):
    """Per language and term: in how many documents the term occurs; added up while a task has room."""
    held: dict[str, tuple[list, list]] = {}
    rows = 0

    def merged(terms, counts):
        whole = pa.concat_arrays(terms).dictionary_encode()
        # Sums far below 2^53, so exact in double precision.
        return [whole.dictionary], [np.bincount(whole.indices.to_numpy(), np.concatenate(counts)).astype(np.int64)]

    def added():
        while held:
            lang, parts = held.popitem()
            (terms,), (sums,) = merged(*parts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.repeat(pa.scalar(lang, pa.string()), len(sums)),
                "term": terms.cast(pa.string()),
                "n": pa.array(sums),
            })

    for batch in slices(batches, SLICE_BYTES):
        data, starts, ends, hashes, owner, number, langs = _tokens(batch)
        for at, lang in enumerate(langs):
            mine = np.flatnonzero(number[owner] == at) if len(langs) > 1 else np.arange(len(owner))
            if not len(mine):
                continue
            term, first = _distinct(data, starts[mine], ends[mine], hashes[mine])
            pairs = np.sort(owner[mine] * len(first) + term)
            new = np.append(True, pairs[1:] != pairs[:-1])
            spans = mine[first]
            terms, counts = held.setdefault(lang, ([], []))
            terms.append(_strings(data, starts[spans], ends[spans]))
            counts.append(np.bincount(pairs[new] % len(first), minlength=len(first)))
            rows += len(first)
        if rows > HELD_TERMS:
            # Terms that several slices share are added up first; what they leave goes on only if it is much.
            for lang, parts in held.items():
                held[lang] = merged(*parts)
            rows = sum(len(terms[0]) for terms, _ in held.values())
            if rows > HELD_TERMS // 2:
                yield from added()
                rows = 0
    yield from added()


def _shard_numbers(hashes: np.ndarray, shards) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.asarray(shards).astype(np.uint64)).astype(np.int32)


def _sharded(batches):
    for batch in batches:
        data, offsets = text_bytes(column(batch, "term"))
        shards = column(batch, "shards").to_numpy()
        numbers = _shard_numbers(term_hashes(data, offsets[:-1], offsets[1:]), shards)
        yield batch.append_column("shard", pa.array(numbers))


_SHARD = (
    "lang string, shard int, shards int, size long, seed int, sizes array<int>, words binary, terms binary, ends binary"
)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    built = TermShard.build([t.encode() for t in frame["term"]])
    lang, shard, shards = frame[["lang", "shard", "shards"]].iloc[0]
    return pd.DataFrame([{"lang": lang, "shard": shard, "shards": shards, "size": len(frame), **built}])


def _recount(rows):
    """Counts of kept terms per group of one round's shards, in dense slots."""

    def run(batches):
        langs = {}
        for lang, shard, shards, base, parts in rows.value:
            langs.setdefault(lang, (shards, {}))[1][shard] = (base, TermShard(*parts))
        # Slots of this round's shards lie behind one another, language by language.
        spans = {
            lang: (min(b for b, _ in held.values()), max(b + len(s.ends) for b, s in held.values()))
            for lang, (_, held) in langs.items()
        }
        counters: dict[int, tuple[int, np.ndarray]] = {}
        tokens = 0

        def flush():
            for group, (base, dense) in counters.items():
                at = np.flatnonzero(dense)
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array(np.full(len(at), group)), "slot": pa.array(at + base), "n": pa.array(dense[at].astype(np.int64)),
                })
            counters.clear()

        for batch in slices(batches, SLICE_BYTES):
            data, starts, ends, hashes, owner, number, names = _tokens(batch)
            owners = column(batch, "group").to_numpy()
            tokens += len(owner)
            if tokens > SLOT_TOKENS:
                yield from flush()
                tokens = len(owner)
            for at, lang in enumerate(names):
                if lang not in langs:
                    continue
                shards, held = langs[lang]
                mine = np.flatnonzero(number[owner] == at) if len(names) > 1 else np.arange(len(owner))
                shard = _shard_numbers(hashes[mine], shards) if shards > 1 else np.zeros(len(mine), np.int32)
                slots = np.full(len(mine), -1, np.int64)
                base, end = spans[lang]
                for which, (begin, terms) in held.items():
                    here = np.flatnonzero(shard == which)
                    spot = mine[here]
                    found = terms.slots(data, starts[spot], ends[spot], hashes[spot])
                    slots[here] = np.where(found >= 0, found + begin - base, -1)
                known = slots >= 0
                group, slots = owners[owner[mine[known]]], slots[known]
                order = np.argsort(group, kind="stable")
                group, slots = group[order], slots[order]
                cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else [0]
                for low, high in zip(cuts[:-1], cuts[1:]):
                    this = int(group[low])
                    if this not in counters:
                        if (sum(len(c) for _, c in counters.values()) + end - base) * 4 > SLOT_BYTES:
                            yield from flush()
                        counters[this] = base, np.zeros(end - base, np.int32)
                    np.add.at(counters[this][1], slots[low:high], 1)
        yield from flush()

    return run


def _listed(batches):
    """Slot and term of every kept term."""
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.frombuffer(row["ends"], np.int64)
            bounds = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
            terms = pa.Array.from_buffers(pa.large_string(), len(ends), [None, bounds, pa.py_buffer(row["terms"])])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([row["lang"]] * len(ends), pa.string()),
                "slot": pa.array(np.arange(len(ends)) + row["base"]),
                "term": terms.cast(pa.string()),
            })


def _compare_sources(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the slots at hand for all pairs of sources of two tiles, and the number of slots."""
    marks = frame[frame["slot"] < 0].sort_values("number")
    cells = frame[frame["slot"] >= 0]
    numbers, tiles = marks["number"].to_numpy(), marks["tile"].to_numpy()
    slots, at = np.unique(cells["slot"].to_numpy(), return_inverse=True)
    p = np.repeat(marks["p"].to_numpy(np.int64)[:, None], len(slots), 1)
    p[np.searchsorted(numbers, cells["number"].to_numpy()), at] = cells["p"].to_numpy(np.int64)
    first, second = frame["left"].iloc[0], frame["right"].iloc[0]
    out = []
    for one, other in {(first, second), (second, first)}:
        others = np.flatnonzero(tiles == other)
        for i in np.flatnonzero(tiles == one):
            rest = others[others != i]
            sums = ((p[i] - p[rest]) ** 2 // p[rest]).sum(1)
            out.append(pd.DataFrame({"number": numbers[i], "other": numbers[rest], "sum": sums}))
    found = pd.concat(out) if out else pd.DataFrame({"number": [], "other": [], "sum": []})
    found["lang"], found["seen"] = frame["lang"].iloc[0], len(slots)
    return found[["lang", "number", "other", "sum", "seen"]]


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term) of terms in at least ``least`` documents of their language."""
    counted = docs.select("text", "lang").mapInArrow(_document_counts, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def term_counts(docs: DataFrame, kept: DataFrame, sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(group, slot, n) of all kept terms that occur in documents (text, lang, group), and (lang, slot, term)."""
    spark = docs.sparkSession
    shards = F.greatest(F.ceil(F.col("v") / SHARD_TERMS), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("int")
    dealt = kept.join(sizes.select("lang", shards.alias("shards")), "lang")
    built = scratch.write(
        dealt.select("lang", "term", "shards")
        .mapInArrow(_sharded, "lang string, term string, shards int, shard int")
        .groupBy("lang", "shard")
        .applyInPandas(_build, _SHARD)
    )
    # One row a shard: where its slots begin, and how much of a broadcast it takes.
    weight = F.octet_length("words") + F.octet_length("terms") + F.octet_length("ends")
    order = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = scratch.write(built.withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0))))
    rounds, room = [], 0
    for row in based.select("lang", "shard", weight.alias("weight")).orderBy("lang", "shard").collect():
        if not rounds or room < row.weight:
            rounds.append([])
            room = BROADCAST_BYTES
        rounds[-1].append((row.lang, row.shard))
        room -= row.weight
    counted = spark.createDataFrame([], "group long, slot long, n long")
    for wanted in rounds:
        # Shards in order: from the first to the last of the round.
        place, low, high = F.struct("lang", "shard"), wanted[0], wanted[-1]
        bound = lambda b: F.struct(F.lit(b[0]).alias("lang"), F.lit(b[1]).alias("shard"))
        held = based.filter((place >= bound(low)) & (place <= bound(high))).collect()
        rows = spark.sparkContext.broadcast(
            [(r.lang, r.shard, r.shards, r.base, (r.seed, r.sizes, bytes(r.words), bytes(r.terms), bytes(r.ends))) for r in held]
        )
        part = docs.mapInArrow(_recount(rows), counted.schema)
        counted = counted.unionByName(part.groupBy("group", "slot").agg(F.sum("n").alias("n")))
    listed = based.select("lang", "base", "terms", "ends").mapInArrow(_listed, "lang string, slot long, term string")
    return scratch.write(counted), listed


def _share(count: str) -> str:
    """The share in whole numbers; by decimals where a long would not hold the product."""
    product = f"1000000000L * ({count} + 1) div (total + v)"
    wide = f"(CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(27,0))) div CAST(total + v AS DECIMAL(27,0))"
    return f"1 + CASE WHEN {count} < 9000000000 THEN {product} ELSE {wide} END"


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least: int = 3, top: int = 200) -> DataFrame:
    """Per (lang, source) and part ``pair`` or ``term``: item, value, rank."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    given = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    )
    kept = scratch.write(kept_terms(given, least))
    # One row a language or group, written so that joins with them are planned by their true size.
    vocabulary = scratch.write(
        kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.octet_length("term")).alias("bytes"))
    )
    names = scratch.write(given.select("lang", "source").distinct())
    names = scratch.write(names.withColumn("group", F.monotonically_increasing_id()))
    grouped = given.join(names, ["lang", "source"]).select("text", "lang", "group")
    counts, terms = term_counts(grouped, kept, vocabulary, scratch)
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = scratch.write(
        names.join(vocabulary.select("lang", "v"), "lang", "left")
        .join(totals, "group", "left")
        .fillna(0, ["v", "total"])
        .withColumn("number", F.row_number().over(by_lang.orderBy("source")) - 1)
        .withColumn("tile", F.floor(F.col("number") / SOURCE_TILE).cast("int"))
        .withColumn("tiles", F.floor(F.max("number").over(by_lang) / SOURCE_TILE).cast("int") + 1)
        .withColumn("none", F.when(F.col("v") > 0, F.expr(_share("0"))))
    )
    # Every count with its share, of the group and of the language.
    filled = scratch.write(
        counts.join(groups, "group")
        .select("lang", "group", "number", "tile", "tiles", "slot", F.expr(_share("n")).alias("p"), "n")
    )
    of_lang = scratch.write(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v")))
    overall = (
        filled.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        .join(of_lang, "lang")
        .select("lang", "slot", F.expr(_share("n")).alias("q"))
    )
    # Ties with the last place go on to where terms decide; until then rows are numbers alone.
    first = Window.partitionBy("group").orderBy(F.desc("value"))
    over = (
        filled.join(overall, ["lang", "slot"]).filter("p > q")
        .select("lang", "group", "slot", F.expr("(p - q) * (p - q) div q").alias("value"))
        .withColumn("rank", F.rank().over(first)).filter(F.col("rank") <= top)
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    over = (
        over.join(terms, ["lang", "slot"])
        .join(names.select("group", "source"), "group")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    )

    paired = ["lang", "number", "tile", "tiles", "slot", "p", "block"]
    marks = groups.filter("v > 0").select(
        "lang", "number", "tile", "tiles", F.lit(-1).cast("long").alias("slot"), F.col("none").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {SLOT_BLOCK}"))).alias("block"),
    )
    cells = filled.withColumn("block", F.expr(f"slot div {SLOT_BLOCK}")).select(*paired).unionByName(marks)
    sums = (
        cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"left": F.least("tile", "with"), "right": F.greatest("tile", "with")})
        .drop("tiles", "with")
        .groupBy("lang", "block", "left", "right")
        .applyInPandas(_compare_sources, "lang string, number int, other int, sum long, seen long")
        .groupBy("lang", "number", "other")
        .agg(F.sum("sum").alias("sum"), F.sum("seen").alias("seen"))
    )
    mine = groups.select("lang", "source", "number", "v", F.col("none").alias("p"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("none").alias("q"))
    unseen = F.expr("(v - seen) * ((p - q) * (p - q) div q)")
    pairs = (
        mine.join(theirs, "lang").filter(F.col("number") != F.col("other"))
        .join(sums, ["lang", "number", "other"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.col("sum") + unseen, F.lit(0)).alias("value"))
    )
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(over).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
