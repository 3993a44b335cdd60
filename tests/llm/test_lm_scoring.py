"""Stupid-backoff scores against brute force."""

import math
import random
from collections import Counter

import pytest

from tessera.llm import lm_scoring


def brute(docs, backoff, least):
    texts = [(d, (t or "").encode().lower().split()) for d, t in docs]
    ones, twos = Counter(), Counter()
    for _, ws in texts:
        ones.update(ws)
        twos.update(zip(ws, ws[1:], strict=False))
    total, out = sum(ones.values()), []
    for d, ws in texts:
        score = 0.0
        for i, w in enumerate(ws):
            if i and twos[ws[i - 1], w] >= least:
                score += math.log(twos[ws[i - 1], w] / ones[ws[i - 1]])
            else:
                score += math.log((backoff if i else 1) * ones[w] / total)
        out.append((d, len(ws), round(score, 6), round(score / len(ws), 6) if ws else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_bytes", "least"), [(24_000_000, 2), (500, 2), (90, 1)])
def test_scores_equal_brute_force(spark, block_bytes, least):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "The", "a", "cat", "é", "x\n\ny", f"r{rng.randrange(50)}"]) for _ in range(rng.randrange(40)))) for i in range(120)]
    docs += [(120, None), (121, ""), (122, " \n"), (5, docs[5][1]), (5, docs[5][1]), (None, "the cat"), (123, "the " * 5000)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, block int")
    found = lm_scoring.score_documents(frame, min_count=least, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6), None if r["per_word"] is None else round(r["per_word"], 6)) for r in found), key=str) == brute(docs, lm_scoring.BACKOFF, least)


def test_empty_table(spark):
    assert lm_scoring.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, lm_scoring.score_documents(only_blank).collect())) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
