"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line of at least ``min_chars`` characters is dropped if an earlier line, in the order of (document id, line number), is
equal or, for lines of at least ``near_min_chars``, at most ``max_edits`` edits away. Equal lines meet in one aggregation.
For the rest, every distinct line is cut into max_edits + 1 segments; lines within the threshold share at least one
segment whose place shifts by no more than the edits to its left and right allow. So each line posts its segments under
(length, segment number, segment) and probes the indexes of its own and the next smaller lengths with the few substrings
that can match. Pairs that meet are verified by a banded bit-parallel automaton: one machine word per error count holds
the reachable diagonals.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import boxed, checkpointed, discarded, materialized, quoted, small

MIN_CHARS = 20
NEAR_MIN_CHARS = 40
MAX_EDITS = 2
#: More than the lines that any text can have.
PLACES = 2**31

#: Sets of at most 32 characters, whose counts part lines that only share a segment.
LETTERS = "abcdefghijklmnopqrstuvwxyz .,"
DIGITS = "0123456789-:/_"

_BLANK = r"^[\x20\x09-\x0D]*$"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _eligible(line: Column, min_chars: int) -> Column:
    return (F.char_length(line) >= min_chars) & ~line.rlike(_BLANK)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")


def eligible_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, pos, line) of the lines that take part; rows without a text have none."""
    lines = rows.select("id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return lines.filter(_eligible(F.col("line"), min_chars))


def first_lines(lines: DataFrame) -> DataFrame:
    """Each distinct line with its first place; copies are combined before the shuffle.

    A place is one number, id * PLACES + pos, so that its minimum is kept in place by a hash aggregation.
    """
    at = F.col("id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    return lines.groupBy("line").agg(F.min(at).alias("at"))


def place_of(at: str) -> tuple[Column, Column]:
    """(id, pos) of a place; ids may be negative."""
    pos = F.expr(f"pmod({at}, {PLACES}BD)")
    return F.expr(f"({at} - pmod({at}, {PLACES}BD)) div {PLACES}BD").cast("long").alias("id"), pos.cast("int").alias("pos")


def _starts(n: Column, edits: int) -> dict[str, Column]:
    """Where the inner segments of lines of n characters and of up to ``edits`` fewer start, named as ``_start`` reads them."""
    parts = edits + 1
    return {f"start_{shorter}_{i}": F.floor((n - shorter) * i / parts).cast("int") for shorter in range(edits + 1) for i in range(1, parts)}


def _start(i: int, shorter: int, n: Column, edits: int) -> Column:
    return F.lit(0) if i == 0 else n - shorter if i > edits else F.col(f"start_{shorter}_{i}")


def _key(length: Column, i: int, wide: Column, start: Column, size: Column) -> Column:
    """The key of ``size`` characters from ``start`` on; ``wide`` holds four bytes for each, so nothing before them is read."""
    return F.xxhash64(length, F.lit(i), F.substring(wide, start * 4 + 1, size * 4))


def segment_keys(wide: Column, n: Column, edits: int) -> Column:
    """The keys under which a line of n characters is found: its own segments."""
    starts = [_start(i, 0, n, edits) for i in range(edits + 2)]
    return F.array(*[_key(n, i, wide, starts[i], starts[i + 1] - starts[i]) for i in range(edits + 1)])


def probe_keys(wide: Column, n: Column, edits: int) -> Column:
    """The keys that a line of n characters looks up: substrings that can equal a segment of a line at most ``edits`` shorter.

    Segment i has at most i edits before it and edits - i after it, so its place moves by at most i from the left and
    by at most edits - i from the right.
    """
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start, size = _start(i, shorter, n, edits), _start(i + 1, shorter, n, edits) - _start(i, shorter, n, edits)
            for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                out.append(_key(n - shorter, i, wide, start + move, size))
    return F.array(*out)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two lines is at most ``edits``, by a banded bit-parallel automaton.

    Bit d of word e is set after i characters of ``a`` if its first i characters are at most e edits from the first
    i + d - edits characters of ``b``. A character moves all diagonals of a word at once: matching ones stay, an edit
    lets them stay (replaced), move down (deleted) or up (inserted) from the word with one edit less.
    """
    width = 2 * edits + 1
    every = (1 << width) - 1

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def step(chars: Column, state: Column, i: Column) -> Column:
        def mask(c: Column) -> Column:
            bits = [F.when(F.get(chars["y"], i + (d - edits)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
            return functools.reduce(Column.bitwiseOR, bits)

        return bound(bound(F.get(chars["x"], i), mask), lambda m: moved(state, m))

    def moved(state: Column, m: Column) -> Column:
        words = [F.shiftright(state, width * e).bitwiseAND(F.lit(every)) for e in range(edits + 1)]
        packed, below = F.lit(0), None
        for e, word in enumerate(words):
            new = word.bitwiseAND(m)
            if e:
                old = words[e - 1]
                new = new.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(below, 1).bitwiseAND(F.lit(every)))
            packed = packed.bitwiseOR(F.shiftleft(new, width * e))
            below = new
        return packed

    begin = sum((((1 << (e + 1)) - 1) << edits) << (width * e) for e in range(edits + 1))
    n, gap = F.char_length(a), F.char_length(b) - F.char_length(a)
    chars = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    last = bound(chars, lambda c: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(begin), lambda s, i: F.when(s == 0, s).otherwise(step(c, s, i))))
    end = F.shiftright(last, edits * width).bitwiseAND(F.call_function("shiftleft", F.lit(1), gap + edits))
    return F.when(F.abs(gap) > edits, F.lit(False)).when((n == 0) | (a == b), F.lit(True)).otherwise(end != 0)


def letter_counts(line: Column, letters: str) -> Column:
    """Counts of up to 32 characters, two bits each, modulo 4 in Gray code: a count that moves by one flips one bit."""
    n, out = F.char_length(line), F.lit(0).cast("long")
    for k, letter in enumerate(letters):
        count = (n - F.char_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(3))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseXOR(F.shiftright(count, 1)).cast("long"), 2 * k))
    return out


def counts_differ(a: Column, b: Column) -> Column:
    """A lower bound on the summed difference of two lines' character counts; an edit changes the counts by two at most."""
    return F.bit_count(a["letters"].bitwiseXOR(b["letters"])) + F.bit_count(a["digits"].bitwiseXOR(b["digits"]))


def keyed_lines(firsts: DataFrame, near_min_chars: int, edits: int) -> DataFrame:
    """at, index, probes: the places of lines and what the near join needs of them, without their texts.

    What keys share is in columns of its own, so that it is computed once a line and not once a key, and the code that
    Spark writes for the keys stays under the 8,000 bytes of bytecode beyond which the JVM only interprets a method.
    """
    wide, n = F.col("wide"), F.col("n")
    near = n >= near_min_chars
    firsts = firsts.select("at", F.encode("line", "UTF-32").alias("wide"))
    firsts = firsts.select("at", "wide", F.floor(F.octet_length("wide") / 4).cast("int").alias("n"))
    firsts = firsts.select("at", "wide", "n", *[c.alias(name) for name, c in _starts(n, edits).items()])
    return firsts.select("at", F.when(near, segment_keys(wide, n, edits)).alias("index"), F.when(near, F.array_distinct(probe_keys(wide, n, edits))).alias("probes"))


def meeting_lines(lines: DataFrame) -> DataFrame:
    """(key, at, held): the keys that two or more lines have, with each line that holds the key or probes it."""
    kinds = [lines.select(F.explode(c).alias("key"), "at", F.lit(c == "index").alias("held")) for c in ("index", "probes")]
    here = Window.partitionBy("key")
    rows = kinds[0].unionAll(kinds[1]).withColumns({"least": F.min("at").over(here), "most": F.max("at").over(here)})
    return rows.filter("least < most").select("key", "at", "held")


def near_pairs(met: DataFrame, text: DataFrame, edits: int) -> DataFrame:
    """(a, b, apart): places of lines that share a segment and have about the same letters, the earlier line first.

    ``apart`` is the lower bound on the difference of their letters.

    Variants of one line that differ in whole words share segments too; their letter counts part them inside the join,
    so what comes out of it follows the number of lines that are near each other.
    """
    known = met.join(text.select("at", F.struct(letter_counts(F.col("line"), LETTERS).alias("letters"), letter_counts(F.col("line"), DIGITS).alias("digits")).alias("counts")), "at")
    index = known.filter("held").select("key", F.col("at").alias("a"), F.col("counts").alias("x"))
    probes = known.filter("not held").select("key", F.col("at").alias("b"), F.col("counts").alias("y"))
    apart = counts_differ(F.col("x"), F.col("y"))
    found = probes.join(index, (probes["key"] == index["key"]) & (F.col("a") != F.col("b")) & (apart <= 2 * edits))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), apart.alias("apart")).distinct()


def lines_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(at, line): the lines at some places, read from the documents again."""
    wanted = places.select("at", *place_of("at")).groupBy("id").agg(F.collect_list(F.struct("at", "pos")).alias("wanted"))
    wanted = small(checkpointed(wanted.withColumnRenamed("id", "i")), width=24 * F.size("wanted"))
    # The text is split once, and only the lines asked for leave the row.
    pick = lambda lines: F.transform("wanted", lambda w: F.struct(w["at"].alias("at"), F.get(lines, w["pos"]).alias("line")))
    found = rows.join(wanted, F.col("id") == F.col("i")).select(F.explode(F.flatten(F.transform(F.array(lines_of(F.col("text"))), pick))).alias("x"))
    return found.select("x.at", "x.line").filter("line is not null")


def near_copies(lines: DataFrame, rows: DataFrame, edits: int) -> DataFrame:
    """Places of lines that have an earlier line within the threshold. Only lines that meet another are read again.

    One earlier line is enough, so each line is compared with the earlier one whose letters are the likest, and only the
    lines that this does not settle are compared with the others they met.
    """
    met = materialized(meeting_lines(lines))
    text = materialized(lines_at(rows, met.select("at").distinct()))
    pairs = materialized(near_pairs(met, text, edits))

    def within(some: DataFrame) -> DataFrame:
        both = some.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b")
        return both.filter(within_edits(F.col("x"), F.col("y"), edits)).select(F.col("b").alias("at"))

    likest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("least")).select("b", "least.a")
    settled = checkpointed(within(likest))
    rest = pairs.select("a", "b").join(settled.withColumnRenamed("at", "b"), "b", "left_anti")
    near = checkpointed(settled.unionAll(within(rest).distinct()))
    discarded(met, text, pairs)
    return near


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS, edits: int = MAX_EDITS) -> DataFrame:
    """(id, kept): sorted numbers of the eligible lines that stay, for each document that keeps any."""
    rows = identified(docs, id_col, text_col)
    lines = materialized(keyed_lines(first_lines(eligible_lines(rows, min_chars)), near_min_chars, edits))
    near = small(near_copies(lines, rows, edits))
    places = lines.select("at").join(near, "at", "left_anti")
    kept = materialized(places.select(*place_of("at")).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("kept")))
    discarded(lines)
    return kept


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS, edits: int = MAX_EDITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (the numbers, from 0) for every row of ``docs``.

    A null or empty text has one empty line at most, which stays; rows with a null id keep all lines. Rows that share an
    id share line numbers: a number stays if it is the first place of a line of any of them, so repeated rows are not
    taken for copies of each other. An empty table gives an empty result.
    """
    kept = kept_lines(docs, id_col, text_col, min_chars, near_min_chars, edits)
    rows = docs.select(F.col(id_col).alias("id"), lines_of(F.col(text_col).cast("string")).alias("lines"))
    eligible = F.transform(F.filter(F.transform("lines", lambda x, i: F.when(_eligible(x, min_chars), i)), lambda i: i.isNotNull()), lambda i: i)
    rows = rows.select("id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(eligible, F.array().cast("array<int>")).alias("eligible"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    joined = rows.join(kept, "id", "left")
    dropped = F.when(F.col("id").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(F.array_except("eligible", F.coalesce("kept", F.array().cast("array<int>")))))
    out = joined.select(F.col("id").alias("doc_id"), "n_lines", dropped.alias("dropped"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_min_chars: int = NEAR_MIN_CHARS, edits: int = MAX_EDITS, keep_emptied: bool = True, least_left: float = 0.0) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; all columns stay, and all rows.

    Unless ``keep_emptied``, a row goes if lines were dropped from it and what is left is blank. With ``least_left``, a
    row also goes if lines were dropped and less than this share of its characters is left: it repeats earlier text.
    """
    kept = kept_lines(docs, id_col, text_col, min_chars, near_min_chars, edits)
    held = boxed(docs, doc=F.col(id_col).cast("long"), lines=lines_of(F.col(text_col).cast("string")))
    joined = held.join(kept, held["doc"] == kept["id"], "left")
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(_eligible(x, min_chars), i)), lambda i: i.isNotNull())
    dropped = F.when(F.col("doc").isNotNull(), F.array_sort(F.array_except(numbers, F.coalesce("kept", F.array().cast("array<int>")))))
    changed = joined.select("row", "lines", dropped.alias("dropped"))
    # The lines between dropped ones, as slices: linear in the number of lines.
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("dropped", k - 1) + 1)
    end = lambda k: F.coalesce(F.get("dropped", k), F.size("lines"))
    parts = F.transform(F.sequence(F.lit(0), F.size("dropped")), lambda k: F.slice("lines", begin(k) + 1, end(k) - begin(k)))
    cleaned = changed.select("row", F.when(F.size("dropped") > 0, F.array_join(F.flatten(parts), "\n")).alias("cleaned"))
    if least_left:
        before = F.char_length(F.col("row").getField(text_col).cast("string"))
        cleaned = cleaned.filter(F.col("cleaned").isNull() | (F.char_length("cleaned") >= F.lit(least_left) * before))
    if not keep_emptied:
        cleaned = cleaned.filter(F.col("cleaned").isNull() | ~F.col("cleaned").rlike(r"^[\x20\x09-\x0D]*$"))
    text = F.coalesce("cleaned", F.col("row").getField(text_col))
    return cleaned.select(F.col("row").withField(quoted(text_col), text).alias("row")).select("row.*")
