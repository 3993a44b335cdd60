"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a cache in each worker.

No pre-token is ever shuffled. A text is cut at its single spaces; a byte-level tokenizer's pre-tokens never reach over
such a cut, so the token count of the text is the sum over the pieces. The lengths of frequent pieces come from a
broadcast table, taken from counts of all documents; a piece that is not in it is encoded once by the tokenizer library and then kept in a bounded cache of
the Python worker. The tables only save time: any text gives the library's count with either table empty.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_column, bound_batches, keyed_text

#: Pieces in the broadcast table and the longest one it takes, which bound it to a few MB.
FREQUENT = 50_000
MAX_PIECE_CHARS = 40
#: Pieces a task reports of those it counted, and pieces it counts at once: beyond that, the rarer half is forgotten.
REPORTED = 20_000
COUNTED = 400_000
#: Pieces a worker's cache holds before it starts anew.
CACHE_PIECES = 400_000


class TokenCounter:
    """Counts tokens of texts as the tokenizer library does, without added special tokens."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_piece, self.special = False, None
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [t for t in spec.get("added_tokens", [])]
        #: Pieces stand alone only for byte-level BPE on raw text; other tokenizers get whole texts.
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None

    def pieces(self, text: str) -> list[str]:
        """Cuts before each single space; a run of spaces stays with what is before it, but for its last one."""
        first, *rest = text.split(" ")
        if "" not in rest:
            return [first, *[f" {x}" for x in rest]] if first else [f" {x}" for x in rest]
        return re.findall(r" ?[^ ]+(?: +(?= [^ ])| +$)?|^ +(?= [^ ])|^ +$", text)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.encode(texts)
        parts: list[list[str]] = []
        base: list[int] = []
        for text in texts:
            found = len(self.special.findall(text)) if self.special and self.special.search(text) else 0
            base.append(found)
            spans = self.special.split(text) if found else [text]
            parts.append([p for s in spans if s for p in self.pieces(s)])
        frequent, cache = self.frequent, self.cache
        misses = {p for pieces in parts for p in pieces if p not in frequent and p not in cache}
        if misses:
            if len(cache) + len(misses) > CACHE_PIECES:
                cache.clear()
                misses = {p for pieces in parts for p in pieces if p not in frequent}
            todo = list(misses)
            for at in range(0, len(todo), 2_000):
                cache.update(zip(todo[at : at + 2_000], self.encode(todo[at : at + 2_000]), strict=True))
        out = []
        for n, pieces in zip(base, parts, strict=True):
            lengths = list(map(frequent.get, pieces))
            out.append(n + (sum(lengths) if None not in lengths else sum(cache[p] if x is None else x for x, p in zip(lengths, pieces, strict=True))))
        return out


_workers: dict[str, TokenCounter] = {}


def _counter(path: str, table: Broadcast | None) -> TokenCounter:
    key = f"{path}#{table.value['id'] if table else ''}"
    if key not in _workers:
        _workers.clear()
        _workers[key] = TokenCounter(path, table.value["lengths"] if table else None)
    return _workers[key]


def frequent_pieces(rows: DataFrame, path: str, n: int = FREQUENT, reported: int = REPORTED, counted: int = COUNTED) -> dict[str, int]:
    """The token counts of the most frequent pieces of all texts.

    Every task counts the pieces of its documents and reports its most frequent ones, so that ``reported`` rows a task
    are shuffled and no pre-token is. What tasks do not report can only change which pieces are in the table.
    """
    counter = TokenCounter(path)
    if not counter.by_piece:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = _counter(path, None).pieces, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cut(text))
            if len(seen) > counted:
                seen = Counter(dict(seen.most_common(counted // 2)))
        found = [x for x in seen.most_common(reported) if len(x[0]) <= MAX_PIECE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["piece", "n"])

    summed = rows.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = [r["piece"] for r in summed.orderBy(F.desc("n"), "piece").limit(n).collect()]
    return dict(zip(pieces, counter.encode(pieces), strict=True)) if pieces else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and repeated or null ids each keep their own result
    row; an empty table gives an empty result. Texts are never truncated; special strings inside them are handled as by
    the library's default.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = keyed_text(docs, id_col, text_col)
    table = frequent_pieces(rows, tokenizer_path)
    shared = spark.sparkContext.broadcast({"id": hash(frozenset(table.items())), "lengths": table})

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(tokenizer_path, shared).count(texts.to_pylist()), pa.int64())

    n = arrow_column(count, "long", F.col("text"))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
