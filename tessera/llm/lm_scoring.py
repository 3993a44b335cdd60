"""Language-model scores by stupid backoff, computed relationally over the whole corpus.

The n-gram count tables are partitioned by hash into buckets, documents into blocks of about BLOCK_BYTES. A block sends
each bucket the distinct n-grams of its documents with their counts, as one row of packed sorted hashes; however frequent
an n-gram is, a bucket gets it once from a block. A bucket adds the counts up and answers with the corpus counts in the
order it was asked. The answers are joined to the block's documents (sent compressed), whose n-grams are laid out anew and scored, and
the scores are summed by document. The order of a block's distinct hashes is the join key, so no hash travels back. A block
and a bucket exchange a row only if the block has n-grams of the bucket, so there are no more rows than distinct n-grams of
blocks. The number of words of the corpus is a factor of the scores that is applied last, from the documents' own numbers.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, keyed_text, materialized

BLOCK_BYTES = 24_000_000
PACK_CHARS = 16_000_000
#: Weight of the shorter n-gram, and how often a longer one must occur to be used.
BACKOFF = 0.4
MIN_COUNT = 2

_ASK = "bucket int, block int, hashes1 binary, counts1 binary, hashes2 binary, counts2 binary"
_TELL = "block int, bucket int, counts1 binary, counts2 binary"


def word_codes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased; Spark fixes the key of Python's hash."""
    words = text.encode().lower().split()
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Block:
    """The documents of a block as one array of words."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.words = mixed(np.concatenate(docs)) if docs else np.zeros(0, np.uint64)
        first = np.zeros(len(self.words), bool)
        first[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        #: Places whose word follows another one of its document.
        self.after = np.flatnonzero(~first)
        with np.errstate(over="ignore"):
            self.pairs = mixed(self.words[self.after - 1] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.after])


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes; a bucket is a range of hashes."""
    edges = [(i << 64) // buckets for i in range(buckets)]
    return np.append(np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a block together and compressed, a bounded number of characters at a time."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    held: dict[int, list[tuple[int | None, str]]] = defaultdict(list)

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"block": pa.array(held, pa.int32()), "docs": pa.array([pack(pickle.dumps(x)) for x in held.values()], pa.binary())})
        held.clear()
        return out

    size = 0
    for batch in batches:
        for block, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[block].append((doc, text))
            size += len(text)
            if size > PACK_CHARS:
                yield packed()
                size = 0
    if held:
        yield packed()


def _unpacked(docs: bytes) -> list[tuple[int | None, str]]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(docs))


def _ask(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs = None, []
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                docs += [word_codes(text) for _, text in _unpacked(packed)]
        if block is None:
            return
        held = Block(docs)
        del docs
        found = [np.unique(x, return_counts=True) for x in (held.words, held.pairs)]
        bounds = [bucket_bounds(h, buckets) for h, _ in found]
        for i in range(buckets):
            parts = [x[b[i] : b[i + 1]] for (h, c), b in zip(found, bounds, strict=True) for x in (h, c.astype(np.int32))]
            if len(parts[0]) or len(parts[2]):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["bucket", "block", "hashes1", "counts1", "hashes2", "counts2"])

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    answers = []
    for order in ("1", "2"):
        sizes = [len(r["hashes" + order]) // 8 for r in rows]
        hashes = np.frombuffer(b"".join(r.pop("hashes" + order) for r in rows), np.uint64)
        counts = np.frombuffer(b"".join(r.pop("counts" + order) for r in rows), np.int32)
        unique, at = np.unique(hashes, return_inverse=True)
        totals = np.bincount(at, counts, len(unique)).astype(np.int64)
        answers.append(np.split(totals[at], np.cumsum(sizes)[:-1]))
    for row, one, two in zip(rows, *answers, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([row["bucket"]], pa.int32()), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], names=["block", "bucket", "counts1", "counts2"])


def block_scores(block: Block, count1: np.ndarray, count2: np.ndarray, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the logarithms of each document's scores, from corpus counts by place.

    Scores of single words are left undivided by the number of words of the corpus; how many there are comes second.
    """
    score, single = np.log(count1), np.ones(len(count1), np.int64)
    at = block.after
    used = count2 >= min_count
    score[at] = np.where(used, np.log(np.maximum(count2, 1) / count1[at - 1]), math.log(backoff) + score[at])
    single[at] = ~used
    out, singles = np.zeros(len(block.sizes)), np.zeros(len(block.sizes), np.int64)
    filled = block.sizes > 0
    if filled.any():
        begin = (np.cumsum(block.sizes) - block.sizes)[filled]
        out[filled], singles[filled] = np.add.reduceat(score, begin), np.add.reduceat(single, begin)
    return out, singles


def _score(backoff: float, min_count: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, answers = [], [], {}
        for batch in batches:
            for _, packed, bucket, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket is None:
                    for doc, text in _unpacked(packed):
                        ids.append(doc)
                        docs.append(word_codes(text))
                else:
                    answers[bucket] = (one, two)
        if not ids:
            return
        block = Block(docs)
        del docs
        # Buckets are ranges of hashes, so their answers in order are those to the sorted hashes.
        by_place = []
        for k, hashes in enumerate((block.words, block.pairs)):
            unique, at = np.unique(hashes, return_inverse=True)
            counts = np.frombuffer(b"".join(answers[b][k] for b in sorted(answers)), np.int64)
            assert len(counts) == len(unique), "a block and its answers differ"
            by_place.append(counts[at] if len(unique) else np.zeros(0, np.int64))
        sums, singles = block_scores(block, *by_place, backoff, min_count)
        for at in range(0, len(ids), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(block.sizes[part], pa.int64()), pa.array(sums[part], pa.float64()), pa.array(singles[part], pa.int64())], names=["doc_id", "n_words", "log_score", "singles"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score and per_word for every row of ``docs``.

    The first word of a text scores count / N; any other c(v w) / c(v) if the pair occurs ``min_count`` times in the
    corpus, else ``backoff`` * c(w) / N. ``log_score`` is the sum of natural logarithms, ``per_word`` its mean. Texts
    without words, and null ones, score 0 with per_word null. Repeated rows count each time and keep a row each; an
    empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    packed = rows.select("block", "doc_id", "text").mapInArrow(_pack, "block int, docs binary")
    asked = packed.repartitionById(n, "block").mapInArrow(_ask(n), _ASK)
    told = asked.repartitionById(n, "bucket").mapInArrow(_tell, _TELL)
    none = {"bucket": "int", "counts1": "binary", "counts2": "binary"}
    asking = packed.select("block", "docs", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    telling = told.select("block", F.lit(None).cast("binary").alias("docs"), *none)
    scored = asking.unionAll(telling).repartitionById(n, "block").mapInArrow(_score(backoff, min_count), "doc_id long, n_words long, log_score double, singles long")
    scored = materialized(scored)
    total = scored.agg(F.sum("n_words").alias("n")).first()["n"] or 1
    score = F.col("log_score") - F.col("singles") * F.lit(math.log(total))
    return scored.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("per_word"))
