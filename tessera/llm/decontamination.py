"""Benchmark decontamination in DataFrame operations: test items inside documents, by MinHash containment.

An item's set is its distinct word shingles. Items are partitioned by the size of their sets into bands. If a share t of
an item's q shingles must lie in a document, then at least one of any q - ceil(t * q) + 1 of them does; an item's MinHash
signature is that many of its smallest shingle hashes, so its length follows from its size and no contained item is
missed. A band's index has a cut, the largest hash in its signatures, and a least size of the documents that can hold one
of its items. A document's side of the sketch is its shingle hashes up to the largest cut among the bands that it is large
enough for; documents are not cut, so long ones are searched whole. Pairs that share a signature value are verified by
exact containment of the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, checkpointed, quoted, small

SHINGLE = 5
CONTAINMENT = 0.8
#: Below every shingle hash that is looked up.
NOTHING = -(2**63)


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; a null text has none."""
    found = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _places(words: str, width: Column) -> Column:
    n = F.size(words) - width
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def hashed_shingles(codes: str, width: int) -> Column:
    """Hashes of all runs of ``width`` word hashes in the column ``codes``."""
    return F.transform(_places(codes, F.lit(width)), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)]))


def text_shingles(words: str, width: Column) -> Column:
    """The distinct runs of ``width`` words themselves."""
    return F.array_distinct(F.transform(_places(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, width and shingles of the items with words; shorter items are one shingle of their own width."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col).cast("string")).alias("words")).filter(F.size("words") > 0).distinct()
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    return rows.select("item_id", "width", text_shingles("words", F.col("width")).alias("shingles"))


def _first_hashed(width: int) -> Callable[[Column], Column]:
    return lambda codes: F.xxhash64(*[F.get(codes, F.lit(k)) for k in range(width)])


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(item_id, width, band, least, hash): the signature values.

    band is the power of two of the set's size, least the number of shingles that a document must hold of the set.
    """
    codes = F.transform("shingles", lambda s: F.transform(F.split(s, " "), lambda w: F.xxhash64(w)))
    rows = sets.withColumn("codes", codes)
    kinds = None
    for width in range(1, SHINGLE + 1):
        hashed = F.transform("codes", _first_hashed(width))
        kinds = F.when(F.col("width") == width, hashed) if kinds is None else kinds.when(F.col("width") == width, hashed)
    rows = rows.withColumn("hashes", F.array_sort(F.array_distinct(kinds)))
    size = F.size("hashes")
    least = F.ceil(size * threshold - 1e-9).cast("int")
    return rows.select("item_id", "width", F.floor(F.log2(size)).cast("int").alias("band"), least.alias("least"), F.explode(F.slice("hashes", F.lit(1), size - least + 1)).alias("hash"))


def _cut(n: Column, bands: list[tuple[int, int]]) -> Column:
    """The largest hash to look up for a document of n shingles: that of the bands (least size, cut) it is large enough for."""
    return F.greatest(*[F.when(n >= least, F.lit(top)) for least, top in bands], F.lit(NOTHING))


def candidates(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that share a signature value. ``rows`` has doc_id and text."""
    # A row for each width and power of two among the items' sizes.
    found = index.groupBy("width", "band").agg(F.min("least").alias("least"), F.max("hash").alias("top")).collect()
    bands: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found):
        bands.setdefault(r["width"], []).append((r["least"], r["top"]))
    coded = rows.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("codes"))
    probes = None
    for width, held in bands.items():
        n = F.size("codes") - (width - 1)
        hashed = coded.select("doc_id", n.alias("n"), _cut(n, held).alias("cut"), hashed_shingles("codes", width).alias("hashes"))
        part = hashed.select("doc_id", "n", F.lit(width).alias("width"), F.explode(F.filter("hashes", lambda h: h <= F.col("cut"))).alias("hash"))
        probes = part if probes is None else probes.unionAll(part)
    if probes is None:
        return rows.select("doc_id", F.lit(None).cast("long").alias("item_id")).limit(0)
    listed = small(index.select("width", "hash", "item_id", "least").distinct())
    return probes.join(listed, ["width", "hash"]).filter(F.col("n") >= F.col("least")).select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment of every item held by a document to at least ``threshold``.

    Items without words are in no document; documents without words hold nothing; an item of fewer than five words is
    one shingle of all its words. Repeated rows count once; rows that share an id give the largest containment of any.
    Null ids are ids like any other. An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = item_sets(items, item_col, item_text_col)
    index = checkpointed(signatures(sets, threshold))
    pairs = checkpointed(candidates(rows, index))
    held = small(pairs.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("item_id")).alias("found")), width=8 * F.size("found"))
    texts = rows.join(held, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "found", words_of(F.col("text")).alias("words"))
    widths = [r["width"] for r in sets.select("width").distinct().collect()]
    by_pair = None
    for width in widths:
        part = texts.select("doc_id", F.explode("found.item_id").alias("i"), text_shingles("words", F.lit(width)).alias("held")).withColumn("w", F.lit(width))
        by_pair = part if by_pair is None else by_pair.unionAll(part)
    if by_pair is None:
        return pairs.select("doc_id", "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    met = by_pair.join(small(sets, width=F.octet_length(F.array_join("shingles", ""))), F.col("i").eqNullSafe(F.col("item_id")) & (F.col("w") == F.col("width")))
    shared = F.size(F.array_intersect("shingles", "held")).cast("long")
    counted = met.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), shared.alias("n_shared"))
    scored = counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay."""
    found = small(checkpointed(contained_items(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("held")).distinct()))
    return docs.join(found, docs[quoted(id_col)].eqNullSafe(found["held"]), "left_anti")
