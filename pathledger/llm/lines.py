"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line is removed where the same line, or one within ``max_edits`` edits of it, starts
earlier (smaller document, or same document and earlier line). Lines are judged on the
input, not on what is left.

A line of length l is cut into max_edits + 1 even segments; a line within the threshold
must hold one of them unchanged, near its place. So every line is indexed under its
segments with their length and number, and probes, for each length down to its own minus
the threshold, the substrings that multi-match-aware selection leaves: their places follow
from constants. Lines that meet are verified by bit-parallel edit distance over the band of
2 * max_edits + 1 diagonals, first on what they have besides the shared segment.

One earlier line within the threshold is enough, so a group of more than ``crowded`` lines
under one key is never compared pair by pair. Its members are compared with its first line,
which settles near copies at once. Where at most ``crowded`` remain that no earlier line has
settled, those are compared with all members; otherwise what the members have besides the
shared segment, and besides a beginning and end common to all, is cut into segments again,
and so on. Lines of one template thus part where
they differ, and a group costs a number of comparisons in proportion to its members. Only
lines that agree in all but ``max_edits`` characters are left in the end, as many as there
are such characters, and compared.

Repeated lines are one from the first grouping on, so a line's number of copies never
multiplies. Lines are the same if two 64-bit hashes are; links are verified on the texts.

Edge cases: blank lines are kept and never compared; lines shorter than ``min_chars`` are
removed only as exact copies; null texts have no lines and stay null; a document without
an id is returned as it is; rows that share an id and text are one document; of different
texts under one id, that of the smaller hash comes first at equal places; an empty text has
one blank line; line ends are "\\n" alone; a very long line or text is one line or text;
an empty table gives an empty one. Other columns pass unchanged, whatever their names, but
for input columns named n_lines or n_removed, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.llm.scratch import Scratch, broadcast_few


def _segment(length: Column, number: int | Column, parts: int) -> tuple[Column, Column]:
    """First character (from 1) and length of a segment (from 1) of a line cut evenly; longer segments come last."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    start = (number - 1) * base + F.greatest(F.lit(0), longer - (parts - number + 1)) + 1
    return start, base + (longer > parts - number).cast("int")


def _cuts(max_edits: int) -> list[tuple[int, int, int]]:
    """(number, less, shift) of all substrings that a line looks for: in a line shorter by ``less``, a segment moved by
    ``shift``. The first max_edits + 1 are the line's own segments, which it is also found by."""
    parts = max_edits + 1
    own = [(number, 0, 0) for number in range(1, parts + 1)]
    asked = []
    for less in range(parts):
        for number in range(1, parts + 1):
            low = max(1 - number, less - (parts - number))
            high = min(number - 1, less + parts - number)
            asked += [(number, less, shift) for shift in range(low, high + 1)]
    return own + [cut for cut in asked if cut not in own]


def _placed(text: Column, length: Column, cut: tuple, max_edits: int):
    """Length of the line looked for, the substring of a cut, what the text has besides, and whether the cut lies inside."""
    number, less, shift = cut
    start, size = _segment(length - less, number, max_edits + 1)
    at = start + shift
    rest = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + size, length))
    return length - less, F.substring(text, at, size), rest, (at >= 1) & (at + size - 1 <= length)


def signatures(line: Column, length: Column, max_edits: int) -> Column:
    """Keys that a line looks under, in the order of :func:`_cuts`; it is found under the first max_edits + 1."""
    keys = []
    for cut in _cuts(max_edits):
        of, piece, _, inside = _placed(line, length, cut, max_edits)
        keys.append(F.when(inside, F.xxhash64(of, F.lit(cut[0]), piece)))
    return F.array(*keys)


def _members(rows: DataFrame, max_edits: int, level: int) -> DataFrame:
    """Rows (first, line, found, rest[, key, less]) under the keys of their rests' segments.

    ``found`` says whether a row is found under its key or only looks there, for a line shorter by ``less``.
    """
    # Cuts are rows, not expressions: each as an expression of its own makes plans that fill the driver.
    cuts = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("number", "by", "shift", "own"), (*cut, i <= max_edits))])
        for i, cut in enumerate(_cuts(max_edits))
    ]
    cut = F.col("cut")
    asked = rows.select("*", F.explode(F.array(*cuts)).alias("cut"))
    of, piece, rest, inside = _placed(F.col("rest"), F.length("rest"), (cut["number"], cut["by"], cut["shift"]), max_edits)
    terms = (of, cut["number"], piece)
    if level:
        inside &= F.col("less") == cut["by"]
        terms += (F.col("key"),)
    return asked.filter(inside).select(
        "first", "line", F.xxhash64(*terms).alias("key"), (F.col("found") & cut["own"]).alias("found"),
        cut["by"].alias("less"), rest.alias("rest"),
    )


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two strings are at most ``max_edits`` edits apart, by bits over a diagonal band.

    After j characters of b, bit d + max_edits of the e-th state says that they come from the
    first j + d characters of a by e edits at most.
    """
    k, width = max_edits, 2 * max_edits + 1
    full = (1 << width) - 1

    def last_state(chars: Column) -> Column:
        """The last state over strings that are split once, not at every step."""
        left, right = chars["a"], chars["b"]

        def step(state: Column, j: Column) -> Column:
            same = F.lit(0)
            for d in range(-k, k + 1):
                equal = F.get(left, j - 1 + d) == F.get(right, j - 1)
                same = same.bitwiseOR(F.when(equal, 1 << (d + k)).otherwise(0))
            # A lambda of its own: compared once a step, and written once in the plan.
            return F.get(F.transform(F.array(F.struct(state.alias("old"), same.alias("same"))), after), 0)

        def after(at: Column) -> Column:
            new = []
            for e in range(k + 1):
                own = at["old"][f"e{e}"].bitwiseAND(at["same"])
                if e:
                    before = at["old"][f"e{e - 1}"]
                    # A changed character, one of b that a lacks, one of a that b lacks.
                    own = own.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
                new.append(own.bitwiseAND(full))
            return F.struct(*[x.alias(f"e{e}") for e, x in enumerate(new)])

        start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << k).alias(f"e{e}") for e in range(k + 1)])
        return F.aggregate(F.sequence(F.lit(1), F.size(right)), start, step)[f"e{k}"]

    split = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")))
    last = F.get(F.transform(split, last_state), 0)
    difference = F.length(a) - F.length(b)
    reached = last.bitwiseAND(F.call_function("shiftleft", F.lit(1), difference + k)) != 0
    return (F.abs(difference) <= k) & ((F.length(b) == 0) | reached)


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that are not blank: doc, mark (hash of the text), pos, line, h1, h2."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("text"))
    lines = rows.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.filter(F.trim("line") != "")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _later(members: DataFrame, others: DataFrame, max_edits: int) -> DataFrame:
    """The later lines (first) of pairs, one of each side, within the threshold that meet under one key."""
    return _after(members, others, max_edits).unionByName(_after(others, members, max_edits)).distinct()


def _after(members: DataFrame, others: DataFrame, max_edits: int) -> DataFrame:
    """The lines (first) of ``members`` that are within the threshold of an earlier one of ``others`` under one key.

    A semi join: one earlier line is enough, so a member is one row at most, however many there are.
    """
    a = members.select("key", F.col("first").alias("a"), F.col("found").alias("fa"), F.col("rest").alias("x"), F.col("line").alias("la"))
    b = others.select(F.col("key").alias("k"), F.col("first").alias("b"), F.col("found").alias("fb"), F.col("rest").alias("y"), F.col("line").alias("lb"))
    near = within_edits(F.col("x"), F.col("y"), max_edits) & within_edits(F.col("la"), F.col("lb"), max_edits)
    met = (F.col("key") == F.col("k")) & (F.col("b") < F.col("a")) & (F.col("fa") | F.col("fb")) & near
    return a.join(b, met, "left_semi").select(F.col("a").alias("first"))


def _common(x: Column, y: Column) -> Column:
    """Number of characters that two strings begin with alike."""
    alike = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(alike, F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.length(x))


def _stripped(members: DataFrame) -> DataFrame:
    """Members without the beginning and end that all rests of their group share: distances stay as they are.

    The least and the greatest string of a group share what all of them do.
    """
    back = F.reverse("rest")
    ends = members.groupBy("key").agg(
        F.min("rest").alias("a"), F.max("rest").alias("z"), F.min(back).alias("ra"), F.max(back).alias("rz"), F.min(F.length("rest")).alias("least"),
    )
    ends = ends.select("key", _common(F.col("a"), F.col("z")).alias("p"), _common(F.col("ra"), F.col("rz")).alias("q"), "least")
    ends = ends.withColumn("q", F.least(F.col("q"), F.col("least") - F.col("p"))).drop("least")
    kept = F.substring("rest", F.col("p") + 1, F.length("rest") - F.col("p") - F.col("q"))
    return members.join(ends, "key").withColumn("rest", kept).drop("p", "q")


def near_lines(members: DataFrame, max_edits: int, crowded: int, scratch: Scratch) -> DataFrame | None:
    """Lines (first) of ``members`` that are within the threshold of an earlier one."""
    later, level = None, 0
    while True:
        groups = members.groupBy("key").agg(
            F.count("*").alias("n"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.max(F.length("rest") - F.col("less")).alias("left"),
            F.min(F.when(F.col("found"), F.struct("first", "rest", "line"))).alias("pivot"),
        )
        groups = scratch.write(groups.filter("lo < hi AND pivot IS NOT NULL").drop("lo", "hi"))
        members = scratch.write(members.join(groups.select("key", "n", "left"), "key"))
        few, many = members.filter(f"n <= {crowded}"), members.filter(f"n > {crowded}")
        pivots = groups.filter(f"n > {crowded}").select("key", F.lit(True).alias("found"), "pivot.*")
        settled = _after(few, few, max_edits).unionByName(_later(pivots, many, max_edits)).distinct()
        settled = scratch.write(settled if later is None else settled.join(later, "first", "left_anti"))
        later = settled if later is None else later.unionByName(settled)
        open_rows = scratch.write(many.join(later, "first", "left_anti"))
        if open_rows.isEmpty():
            return later
        # Few lines that nothing has settled, or hardly any text left: against all members. Else on to the next level.
        sizes = scratch.write(open_rows.groupBy("key").agg((
            (F.count("*") <= crowded) | (F.max("left") <= max_edits)).alias("closing")))
        ends = sizes.filter("closing").select("key")
        settled = scratch.write(_later(open_rows.join(ends, "key", "left_semi"), many, max_edits).join(later, "first", "left_anti"))
        later = later.unionByName(settled)
        wide = _stripped(many.join(sizes.filter("NOT closing").select("key"), "key", "left_semi"))
        level += 1
        members = scratch.write(_members(wide, max_edits, level))
        if members.isEmpty():
            return later


def repeated_lines(docs: DataFrame, scratch: Scratch, key="doc_id", text="text", max_edits: int = 1, min_chars: int = 16,
                   crowded: int = 16) -> DataFrame:
    """Lines to remove: doc, mark, pos. Groups of up to ``crowded`` lines under one key are compared pair by pair."""
    lines = _lines(docs, key, text)
    length = F.length("line")
    keys = F.when(length >= max(min_chars, max_edits + 1), signatures(F.col("line"), length, max_edits))
    places = scratch.write(lines.select("doc", "mark", "pos", "h1", "h2", keys.alias("keys")), codec="snappy")
    at = F.struct("doc", "pos", "mark")
    firsts = scratch.write(places.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")))

    held = places.select("h1", F.posexplode("keys").alias("i", "key")).filter("key IS NOT NULL")
    met = held.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("i").alias("i"))
    # Few keys have several lines: they go to all lines, instead of all keys of all lines to them.
    met = broadcast_few(scratch.write(met.filter(f"lo < hi AND i <= {max_edits}").select("key")))
    wanted = broadcast_few(scratch.write(held.join(met, "key", "left_semi").select("h1").distinct()))
    texts = lines.join(wanted, "h1", "left_semi").select("h1", "h2", "line").dropDuplicates(["h1", "h2"])
    texts = texts.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]).select("first", "line", F.col("line").alias("rest"), F.lit(True).alias("found"))
    members = scratch.write(_members(texts, max_edits, 0).join(met, "key", "left_semi"))
    near = near_lines(members, max_edits, crowded, scratch).withColumn("near", F.lit(True))
    marked = firsts.join(near, "first", "left").filter("n > 1 OR near")
    gone = places.drop("keys").join(scratch.write(marked), ["h1", "h2"]).filter(F.coalesce("near", F.lit(False)) | (at != F.col("first")))
    return gone.select("doc", "mark", "pos")


def dedup_lines(docs: DataFrame, key="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with its lines deduplicated, and n_lines, n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = repeated_lines(docs, scratch, key, text, **options)
    gone = scratch.write(gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone")))
    scratch.drop_all_but(gone)
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    old, names = F.col("row").getField(text), [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    on = (F.col("row").getField(key).cast("long") == F.col("doc")) & (F.xxhash64(old) == F.col("mark"))
    lines = F.split(old, "\n")
    # Bits of removed places would need as many as lines: places are looked up in a map instead.
    dropped = F.map_from_arrays(F.col("gone"), F.transform("gone", lambda _: F.lit(True)))
    kept = F.when(F.col("gone").isNull(), old).otherwise(
        F.array_join(F.filter(lines, lambda _, i: F.element_at(dropped, i).isNull()), "\n")
    )
    return own.join(gone, on, "left").select(
        *[(kept if c == text else F.col("row").getField(c)).alias(c) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
