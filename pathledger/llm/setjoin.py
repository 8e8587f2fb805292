"""Near-duplicate documents by a chosen-path similarity join of their shingle sets.

Every set has a sketch of minhash coordinates. A tree starts with all sets in one node; a
node picks two coordinates by a hash of its path and sends each set to the child that its
value of each names, so sets of similarity s stay together in 2 s children on average.
Nodes of few sets are compared exhaustively, larger ones branch on. Over any depth a pair
at s = 0.8 is lost by one tree with probability 1/16 at most (the fixed point of
q = (0.2 + 0.8 q)^2), by eight independent trees with 3e-10. Sketches that fall five standard
errors short lose it with about 2e-7.

Comparing means: members that agree with one of another component in enough of their tags are
suspects, and the suspects of a node meet once more, with their full sets. Only links that join
components leave that meeting, a spanning forest, so rows out never outnumber members, however
many pairs are alike without linking. A tag is a sketch cut to one byte a coordinate, a quarter
of its size: equal coordinates have equal bytes, so no pair that its sketches would propose is
lost, and of unequal ones 1 in 256 agree by chance. Members travel with their tags; sketches are
only read to branch, full sets are computed of suspects alone. Suspects that have met in one node
do not meet again as the same group.

A node within one component is done. One tree goes ahead of the others, so that they only meet
what it has left apart. A large node is cut into blocks that all hold a few members in common,
so that thousands of near copies join at once. What then lies outside its largest component is
compared with all members, chunk by chunk, once it is few sets (twice as many at each level, as
those that stay together are alike), and after the last level always, so no node's size is capped.

Equal sets are one class from the start. Sets are never gathered beyond a block or two chunks.

Edge cases: texts without words and null texts have an empty set and link with nothing; a
text shorter than a shingle is one shingle of all its words; a document without an id
links with nothing and is returned with a null component; rows that share an id are one
document in links, whatever their texts, each returned (those without words by themselves);
columns other than id and text are not read; a very long text is one set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm.graph import components
from pathledger.llm.scratch import Scratch, broadcast_few
from pathledger.llm.text import column, gram_hashes, lower_ascii, mix, slices, span_hashes, text_bytes, word_hashes, word_spans

SLICE = 1 << 20
COORDINATES = 128
SHARE = 0.18  # below the threshold by five standard errors of a sketch: such pairs are not proposed
_rng = np.random.default_rng(20180610)
_FACTORS = _rng.integers(1 << 63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1 << 63, size=COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words, A-Z in lower case."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, size)
    sets = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            sets.append(span_hashes(words[a:b], np.array([0]), np.array([b - a])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash coordinates of non-empty sets."""
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        values = ((flat * _FACTORS[c] + _SHIFTS[c]) >> np.uint64(32)).astype(np.uint32)
        out[:, c] = np.minimum.reduceat(values, begins)
    return out


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _set_keys(sets) -> np.ndarray:
    """Two 64-bit keys of each set, by which equal sets are one class."""
    keys = [(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)) if len(s) else 0) for s in sets]
    return np.array(keys, np.uint64).reshape(-1, 2)


def _sketched(size: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            sets = shingle_sets(column(batch, "text"), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = dict(zip(full, sketches([sets[i] for i in full]) if full else [], strict=True))
            keys = _set_keys(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys[:, 0].view(np.int64)),
                    pa.array(keys[:, 1].view(np.int64)),
                    _binary([rows[i].tobytes() if i in rows else None for i in range(len(sets))]),
                    _binary([rows[i].astype(np.uint8).tobytes() if i in rows else None for i in range(len(sets))]),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "sketch", "tag"],
            )

    return run


def _branches(key: np.ndarray, sketch: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, set) rows: the row each comes from, and its key."""
    order = mix(key[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(COORDINATES, dtype=np.uint64)[None, :])
    picked = np.argpartition(order, width, axis=1)[:, :width]
    value = np.take_along_axis(sketch, picked, 1).astype(np.uint64)
    child = mix(mix(key)[:, None] + picked.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + value)
    return np.repeat(np.arange(len(key)), width), child.ravel()


def _sketch_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, "sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(trees: range):
    def run(batches):
        for batch in batches:
            reps, sketch = column(batch, "rep").to_numpy(), _sketch_rows(batch)
            for tree in trees:
                rows, child = _branches(np.full(len(reps), mix(np.array([tree + 1], np.uint64))[0]), sketch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(reps[rows])], names=["key", "rep"]
                )

    return run


def _children(batches):
    for batch in batches:
        keys, reps = column(batch, "key").to_numpy().view(np.uint64), column(batch, "rep").to_numpy()
        rows, child = _branches(keys, _sketch_rows(batch))
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(reps[rows])], names=["key", "rep"])


def suspected(group: np.ndarray, tag: np.ndarray, least: float) -> np.ndarray:
    """Which members agree on ``least`` or more of their tags with one of another group."""
    out = np.zeros(len(group), bool)
    # Any two groups have a member outside the largest one.
    for i in np.flatnonzero(group != _largest(group)):
        met = (np.count_nonzero(tag == tag[i], axis=1) >= least * COORDINATES) & (group != group[i])
        if met.any():
            out |= met
            out[i] = True
    return out


def forest(reps: np.ndarray, group: np.ndarray, sets: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that join all groups which any such links join."""
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    values, items = np.unique(np.concatenate(sets), return_inverse=True)
    held, group, out = np.zeros(len(values), bool), group.copy(), []
    for i in np.flatnonzero(group != _largest(group)):
        if (group == group[i]).all():
            break
        own = items[begins[i] : begins[i] + sizes[i]]
        held[own] = True
        both = np.add.reduceat(held[items], begins, dtype=np.int64)
        held[own] = False
        links = np.flatnonzero((group != group[i]) & (100 * both >= least * (sizes + sizes[i] - both)))
        while len(links):
            out.append((int(reps[i]), int(reps[links[0]])))
            group[group == group[links[0]]] = group[i]
            links = links[group[links] != group[i]]
    return out


def _largest(group: np.ndarray):
    names, sizes = np.unique(group, return_counts=True)
    return names[sizes.argmax()]


def _whole_groups(batches, *names: str):
    """Batches sorted by ``names``, cut so that no group of equal values is split; and the groups' begins."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        begins = _begins(table, names)
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), np.append(begins[:-1], begins[-1])
        held = table.slice(begins[-1]) if len(begins) else table
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _begins(table: pa.Table, names) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _suspects(least: float):
    """Suspects of each node or block, under two 64-bit keys of the set of them."""

    def run(batches):
        for table, begins in _whole_groups(batches, "key", "block"):
            reps, comp = (table.column(c).to_numpy() for c in ("rep", "comp"))
            tag = np.frombuffer(b"".join(table.column("tag").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            sizes = np.diff(begins)
            two = begins[:-1][sizes == 2]
            two = two[(comp[two] != comp[two + 1]) & (reps[two] != reps[two + 1])]
            two = two[np.count_nonzero(tag[two] == tag[two + 1], axis=1) >= least * COORDINATES]
            found = list(np.stack([two, two + 1], 1))
            for lo, hi in zip(begins[:-1][sizes > 2], begins[1:][sizes > 2], strict=True):
                first = np.unique(reps[lo:hi], return_index=True)[1] + lo
                found.append(first[suspected(comp[first], tag[first], least)])
            rows = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
            counts = np.array([len(f) for f in found if len(f)], np.int64)
            marks = mix(reps[rows].view(np.uint64))
            starts = np.cumsum(counts) - counts
            keys = [
                np.repeat(np.add.reduceat(m, starts) if len(counts) else m, counts).view(np.int64)
                for m in (marks, mix(marks ^ np.uint64(0xD6E8FEB86659FD93)))
            ]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, keys), pa.array(reps[rows]), pa.array(comp[rows])], names=["s1", "s2", "rep", "comp"]
            )

    return run


def _confirm(least: int):
    """Of each group of suspects, the links on their full sets that join components."""

    def run(batches):
        for table, begins in _whole_groups(batches, "s1", "s2"):
            reps, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
            blobs, linked = table.column("shingles"), []
            for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in blobs.slice(lo, hi - lo).to_pylist()]
                linked += forest(reps[lo:hi], comp[lo:hi], sets, least)
            columns = list(zip(*linked, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return run


def _full_sets(size: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            sets = shingle_sets(column(batch, "text"), size)
            keys = _set_keys(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 _binary([s.tobytes() for s in sets])],
                names=["n_shingles", "k1", "k2", "shingles"],
            )

    return run


def near_duplicates(docs: DataFrame, key="doc_id", text="text", size: int = 5, percent: int = 80, trees: int = 8,
                    node: int = 64, levels: int = 8, chunk: int = 512) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    ``size`` words a shingle; sets link if 100 * intersection >= ``percent`` * union. Nodes up
    to ``node`` sets are compared at once, larger ones branch for ``levels`` levels or are
    finished by comparing chunks of ``chunk`` sets.
    """
    scratch = Scratch(docs.sparkSession, "setjoin")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = scratch.write(
        rows.mapInArrow(_sketched(size), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, tag binary")
    )
    same = ["n_shingles", "k1", "k2"]
    classes = scratch.write(
        sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same)
        .agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"), F.first("tag").alias("tag"))
        # A number of its own, fixed by the write: one id may stand for several sets.
        .withColumn("rep", F.monotonically_increasing_id())
    )
    known = classes.select("rep", "sketch", "tag")
    links = _Links(rows, classes.select("rep", "first_id", *same), size, percent, scratch)
    # One tree first: nearly all links show in it, and the other trees' nodes within one component are done.
    for some in (range(1), range(1, trees)):
        nodes = scratch.write(_crowded(known.mapInArrow(_roots(some), "key long, rep long")))
        held, level = known, 0
        while not nodes.isEmpty():
            most = chunk << (level + 1)
            alive = scratch.write(_alive(nodes, links.comps).join(held.select("rep", "tag"), "rep"))
            few, many = alive.filter(f"n <= {node}"), _ranked(alive.filter(f"n > {node}"), scratch)
            large = scratch.write(many.filter(f"others > {most}"))
            groups = few.select("key", F.lit(0).cast("long").alias("block"), "rep", "comp", "tag")
            groups = groups.unionByName(_against_all(many.filter(f"others <= {most}"), chunk))
            links.settle(groups.unionByName(_blocks(large, node)))
            scratch.drop(nodes, alive)
            if large.isEmpty():
                scratch.drop(large)
                break
            # Sets that share a passage part at the next levels; those that stay together through many are near copies.
            left = scratch.write(_ranked(scratch.write(_alive(large.select("key", "rep", "n", "tag"), links.comps)), scratch))
            ending = "true" if level >= levels else f"others <= {most}"
            links.settle(_against_all(left.filter(ending), chunk))
            wide = scratch.write(left.filter(f"NOT ({ending})").select("key", "rep"))
            # Few sets go on: their sketches and tags alone travel from here.
            few = broadcast_few(scratch.write(wide.select("rep").distinct()))
            held = scratch.write(held.join(few, "rep", "left_semi"))
            nodes = scratch.write(_crowded(wide.join(held, "rep").mapInArrow(_children, "key long, rep long")))
            scratch.drop(large, left)
            level += 1
    comps = links.comps
    described = classes.select(*same, "rep", "first_id")
    comps = _with_ids(sets, described, comps, same, scratch)
    if comps is not None:
        lowest = comps.join(described, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first_id").alias("low"))
        named = comps.join(lowest, "component").select(F.col("node").alias("rep"), "low")
        described = described.join(scratch.write(named), "rep", "left").withColumn("first_id", F.coalesce("low", "first_id"))
    classes = described.select(*same, F.col("first_id").alias("component"))
    ids = sets.select("doc_id", *same).join(scratch.write(classes), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = scratch.write(ids.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    ))
    scratch.drop_all_but(found)
    return found


class _Links:
    """Components so far, and the groups of suspects that have met."""

    def __init__(self, rows: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch):
        self._rows, self._classes, self._size, self._percent, self._scratch = rows, classes, size, percent, scratch
        self._met: DataFrame | None = None
        self.comps: DataFrame | None = None

    def settle(self, groups: DataFrame) -> None:
        """Join all components that links between members of one group (key, block, rep, comp, tag) join."""
        rows = groups.repartition("key", "block").sortWithinPartitions("key", "block")
        least = self._percent / 100 - SHARE
        suspects = rows.mapInArrow(_suspects(least), "s1 long, s2 long, rep long, comp long").dropDuplicates(["s1", "s2", "rep"])
        if self._met is not None:
            suspects = suspects.join(self._met, ["s1", "s2"], "left_anti")
        suspects = self._scratch.write(suspects.join(self._classes, "rep"))
        if suspects.isEmpty():
            return
        met = suspects.select("s1", "s2").distinct()
        self._met = met if self._met is None else self._met.unionByName(met)
        same = ["n_shingles", "k1", "k2"]
        ids = self._scratch.write(suspects.select("first_id").distinct())
        texts = self._rows.join(broadcast_few(ids), F.col("doc_id") == F.col("first_id"), "left_semi").filter("text IS NOT NULL")
        full = texts.mapInArrow(_full_sets(self._size), "n_shingles long, k1 long, k2 long, shingles binary").dropDuplicates(same)
        members = full.join(suspects, same).select("s1", "s2", "rep", "comp", "shingles")
        members = members.repartition("s1", "s2").sortWithinPartitions("s1", "s2")
        found = self._scratch.write(members.mapInArrow(_confirm(self._percent), "a long, b long"))
        if not found.isEmpty():
            self.comps = self._scratch.write(_merged(self.comps, found, self._scratch))


def _with_ids(sets: DataFrame, classes: DataFrame, comps: DataFrame | None, same: list[str], scratch: Scratch):
    """Components that also join the classes of ids with several texts."""
    given = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = given.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    held = scratch.write(
        given.join(twice, "doc_id", "left_semi").select("doc_id", *same).join(classes, same).select("doc_id", "rep").distinct()
    )
    least = held.groupBy("doc_id").agg(F.min("rep").alias("b"))
    links = scratch.write(held.join(least, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    if links.isEmpty():
        return comps
    if comps is not None:
        links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return scratch.write(components(links, scratch))


def _crowded(nodes: DataFrame) -> DataFrame:
    """Members (key, rep, n) of nodes with two sets or more."""
    sizes = nodes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return nodes.join(sizes, "key")


def _named(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members of nodes with their component ``comp``."""
    if comps is None:
        return members.withColumn("comp", F.col("rep"))
    named = comps.select(F.col("node").alias("rep"), "component")
    return members.join(named, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _alive(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Members of nodes that hold more than one component, with their component."""
    named = _named(nodes, comps)
    if comps is None:
        return named
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return named.join(mixed.select("key"), "key", "left_semi")


def _merged(comps: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links: only what the links touch is worked out again."""
    if comps is None:
        return components(links, scratch)
    for end in ("a", "b"):
        named = comps.select(F.col("node").alias(end), "component")
        links = links.join(named, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    touched = scratch.write(components(links.filter("a <> b"), scratch))
    moved = touched.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = comps.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return old.unionByName(touched.join(comps, "node", "left_anti"))


def _blocks(big: DataFrame, node: int) -> DataFrame:
    """Members of large nodes cut into blocks, and some members of a node in each of them."""
    shared = max(1, node // 8)
    count = F.ceil(F.col("n") / (node - shared)).cast("long")
    picked = [F.min_by("rep", F.xxhash64(F.lit(i), "rep")) for i in range(shared)]
    pivots = big.groupBy("key").agg(F.array_distinct(F.array(*picked)).alias("reps")).select("key", F.explode("reps").alias("rep"))
    spread = big.join(pivots, ["key", "rep"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    dealt = big.withColumn("block", F.pmod(F.xxhash64("rep"), count))
    columns = ["key", "block", "rep", "comp", "tag"]
    return dealt.select(*columns).unionByName(spread.select(*columns))


def _ranked(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members with ``other``, whether they lie outside their node's largest component, and their number ``others``."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("size"))
    top = sizes.groupBy("key").agg(
        F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all")
    ).select("key", F.col("top.comp").alias("largest"), (F.col("all") - F.col("top.size")).alias("others"))
    named = members.join(scratch.write(top), "key")
    return named.withColumn("other", F.col("comp") != F.col("largest")).drop("largest")


def _against_all(members: DataFrame, chunk: int) -> DataFrame:
    """Every chunk of members outside the largest component with every chunk of all members, as one group each."""
    rows = F.ceil(F.col("others") / chunk).cast("int")
    columns = F.ceil(F.col("n") / chunk).cast("int")
    every = members.select("*", F.pmod(F.xxhash64("rep"), columns).alias("j"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"))
    few = members.filter("other").select(
        "*", F.pmod(F.xxhash64(F.lit(1), "rep"), rows).alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j")
    )
    # Long: products of chunk numbers may pass 32 bits.
    block = (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("block")
    return every.select("key", "rep", "comp", "tag", block).unionByName(few.select("key", "rep", "comp", "tag", block))


def drop_near_duplicates(docs: DataFrame, key="doc_id", **options) -> DataFrame:
    """The documents of which each group of near duplicates keeps one, with all their columns."""
    found = near_duplicates(docs, key=key, **options).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.join(found, F.col(key).cast("long") == F.col("__kept_id"), "left_semi")
    return kept.unionByName(docs.filter(F.col(key).isNull()))
