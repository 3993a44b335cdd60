"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule votes good (0), bad (1) or abstains (2). A document's votes are one number, its pattern, so all the corpus
has to give is the count of each pattern: at most 3 ** len(RULES) numbers, from one small aggregation over every row.
EM estimates, for either class of documents, how often each rule votes bad, and the share of bad documents, under priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_column, bound_batches, checkpointed, keyed_text

GOOD, BAD, ABSTAIN = 0, 1, 2

# Symbols that prose seldom holds, white space, and frequent function words of five languages.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FUNCTION_WORDS = frozenset(w.encode() for w in "the of and to in a is that for de la el los que y en un una le les des et du der die und das den mit von zu il di e che per".split())

WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed += (codes[i : i + n] ^ (codes[i : i + n] >> np.uint64(29))) * _MIX[i]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in at)  # equal hashes are checked word by word
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def features(text: str | None) -> dict[str, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_upper": len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_letters": len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")),
        "n_shouts": text.count("!"),
        "n_function": len(FUNCTION_WORDS.intersection(raw.lower().split())),
        "longest_word": max(map(len, words), default=0),
    }


FEATURES = list(features(""))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: What is known before of the rules: how often one votes bad on good documents (the thresholds are lenient, so seldom)
#: and on bad ones, and the share of bad documents. A prior weighs as so many times the documents of the corpus. The one
#: on false alarms outweighs the data: with a light one, EM takes a frequent kind of bad documents for the good class.
FALSE_ALARMS = 0.001
LOOSE_FALSE_ALARMS = {"function_words": 0.1, "repeated_lines": 0.025}
HITS, BAD_SHARE = 0.2, 0.1
WEIGHTS, SHARE_WEIGHT = (10.0, 0.01), 1.0

#: Name -> vote, as Columns over the features.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(F.col("n_words") < 10, F.col("n_words") >= 50),
    "word_length": lambda: _vote((_share("word_chars", "n_words") < 2.5) | (_share("word_chars", "n_words") > 15), _share("word_chars", "n_words").between(3, 12)),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") > 0.1, _share("n_symbols", "n_words") < 0.02),
    "repeated_words": lambda: _vote(_share("n_repeat_words", "n_words") > 0.2, _share("n_repeat_words", "n_words") < 0.05),
    "repeated_lines": lambda: _vote(_share("n_dup_lines", "n_lines") > 0.3, F.col("n_dup_lines") == 0),
    "upper_case": lambda: _vote(_share("n_upper", "n_letters") > 0.4, _share("n_upper", "n_letters") < 0.2),
    "shouting": lambda: _vote(_share("n_shouts", "n_words") > 0.1, _share("n_shouts", "n_words") < 0.02),
    "function_words": lambda: _vote((F.col("n_words") >= 50) & (F.col("n_function") == 0), F.col("n_function") >= 2),
    "giant_word": lambda: _vote(F.col("longest_word") > 1000, F.col("longest_word") < 100),
}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def pattern() -> Column:
    """All votes as one number, base 3, and whether the base rules fail as its last digit."""
    code = F.lit(0)
    for vote in (make() for make in RULES.values()):
        code = code * 3 + vote
    return (code * 2 + base_failed().cast("int")).alias("pattern")


def votes_of(codes: np.ndarray) -> np.ndarray:
    """(patterns, rules) matrix of votes."""
    codes = codes // 2
    return np.stack([(codes // 3**i) % 3 for i in reversed(range(len(RULES)))], axis=1)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, weights: tuple[float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each vote pattern, P(bad vote | class) as (rules, 2), and the share of bad documents.

    Abstentions carry no evidence. Rates and share maximise the posterior under Beta priors, of ``weights`` for good and
    bad documents; nothing else binds them. The result depends on the pattern shares, not on the corpus size.
    """
    prior = np.stack([np.array([LOOSE_FALSE_ALARMS.get(r, FALSE_ALARMS) for r in RULES]), np.full(len(RULES), HITS)], axis=1)
    rates, share_bad, total = prior.copy(), BAD_SHARE, counts.sum()
    bad, cast = (votes == BAD).astype(float), (votes != ABSTAIN).astype(float)
    good_prob = np.ones(len(votes))
    for _ in range(rounds if total else 0):
        logs = [np.log(1 - share_bad), np.log(share_bad)]
        for c in (0, 1):
            logs[c] = logs[c] + bad @ np.log(rates[:, c]) + (cast - bad) @ np.log(1 - rates[:, c])
        good_prob = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))  # exp overflows beyond
        for c, p in ((0, good_prob), (1, 1 - good_prob)):
            mass = weights[c] * total
            rates[:, c] = ((p * counts) @ bad + mass * prior[:, c]) / ((p * counts) @ cast + mass)
        share_bad = float(((1 - good_prob) @ counts + SHARE_WEIGHT * total * BAD_SHARE) / (total * (1 + SHARE_WEIGHT)))
    return good_prob, rates, share_bad


def posteriors(patterns: DataFrame) -> dict[int, float]:
    """P(good) by pattern, from the counts of all rows' patterns."""
    found = patterns.groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in found], np.int64)
    good, _, _ = expectation_maximisation(votes_of(codes), np.array([r["count"] for r in found], float))
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


def with_features(rows: DataFrame) -> DataFrame:
    kind = pa.struct([(name, pa.int64()) for name in FEATURES])

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], kind)

    schema = ", ".join(f"{name} long" for name in FEATURES)
    return rows.withColumn("__features", arrow_column(run, schema, F.col("text")))


def _posterior_column(spark: Any, by_pattern: dict[int, float]) -> DataFrame:
    rows = [(int(k), float(v)) for k, v in by_pattern.items()]
    return F.broadcast(spark.createDataFrame(rows, "pattern int, posterior double"))  # at most 2 * 3 ** len(RULES) rows


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: features, base_failed, posterior (of being good) and kept.

    ``kept`` is false if a base rule fails, else whether the posterior reaches the threshold. Null texts count as
    empty and fail; repeated rows, and repeated or null ids, keep a row each; a posterior that equals the threshold keeps
    its documents; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = with_features(keyed_text(docs, id_col, text_col)).select("doc_id", "__features.*")
    found = checkpointed(rows.select("*", base_failed().alias("base_failed"), pattern()))
    table = _posterior_column(docs.sparkSession, posteriors(found))
    judged = found.join(table, "pattern", "left").drop("pattern")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Texts are read twice rather than stored with their votes."""
    spark = docs.sparkSession
    bound_batches(spark)
    patterns = with_features(keyed_text(docs, text_col, text_col).select("text")).select("__features.*").select(pattern())
    keep = {p for p, good in posteriors(patterns).items() if p % 2 == 0 and good >= threshold}
    features_of = with_features(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("__row")))
    code = features_of.select("__row", "__features.*").select("__row", pattern())
    return code.filter(F.col("pattern").isin(sorted(keep))).select("__row.*")
