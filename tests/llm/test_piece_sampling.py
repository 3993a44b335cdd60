"""Sampled segmentations against enumeration of whole lattices."""

import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import piece_sampling as ps

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sampler():
    return ps.Sampler(MODEL, 3)


def segmentations(model, norm):
    """Every path of the lattice with its normalised log-probability."""
    out = [[] for _ in range(len(norm) + 1)]
    out[0] = [((), 0.0)]
    for i in range(len(norm)):
        edges = [(j, (model.ids[norm[i:j]],), model.logs[model.ids[norm[i:j]]]) for j in range(i + 1, len(norm) + 1) if norm[i:j] in model.ids]
        if norm[i] not in model.ids:
            run = tuple(model.byte_ids[b] for b in norm[i].encode())
            edges.append((i + 1, run, sum(model.logs[b] for b in run)))
        for j, ids, p in edges:
            out[j] += [(a + ids, q + p) for a, q in out[i]]
    total = math.log(sum(math.exp(p) for _, p in out[-1]))
    return {ids: p - total for ids, p in out[-1]}


@pytest.mark.parametrize("text", ["the cat", "a", "x\ny", "你好😀", "  two", "Éa "])
def test_samples_are_distinct_paths_with_their_probabilities(sampler, text):
    want = segmentations(sampler.model, sampler.model.normalize(text))
    for seed in range(30):
        ((arrays, facts),) = sampler.sample([text], [seed])
        found = [tuple(a.tolist()) for a in arrays]
        assert len(set(found)) == len(found) == min(3, len(want))
        assert all(abs(want[f] - p) < 1e-5 for f, (p, _, _) in zip(found, facts, strict=True))
        values = [v for _, v, _ in facts]
        assert values == sorted(values, reverse=True)
        assert all(i <= 1e-9 for _, _, i in facts)


def test_frequencies_follow_sampling_without_replacement(sampler):
    text = "to on"
    want = segmentations(sampler.model, sampler.model.normalize(text))
    n = 4000
    firsts, pairs, inclusion = Counter(), Counter(), Counter()
    for arrays, facts in sampler.sample([text] * n, list(range(n))):
        found = [tuple(a.tolist()) for a in arrays]
        firsts[found[0]] += 1
        pairs[tuple(found[:2])] += 1
        for f, (_, _, log_inclusion) in zip(found, facts, strict=True):
            inclusion[f] += 1 / math.exp(log_inclusion)
    for ids, p in want.items():
        assert abs(firsts[ids] / n - math.exp(p)) < 0.04
        assert abs(inclusion[ids] / n - 1) < 0.35 or math.exp(p) < 0.02  # Horvitz-Thompson: each path counts once
    for (a, p), (b, q) in itertools.permutations(want.items(), 2):
        assert abs(pairs[a, b] / n - math.exp(p + q) / (1 - math.exp(p))) < 0.04


def test_samples_do_not_depend_on_the_batch(sampler):
    texts = ["the cat sat on the mat", "", "ünï", "word " * 50]
    together = list(sampler.sample(texts, [5, 6, 7, 8]))
    for i, text in enumerate(texts):
        ((arrays, facts),) = ps.Sampler(MODEL, 3).sample([text], [5 + i])
        assert [a.tolist() for a in arrays] == [a.tolist() for a in together[i][0]]
        assert np.allclose(facts, together[i][1])


def test_query_round_trip_and_corner_cases(spark):
    texts = [None, "", " ", "a", "the cat  sat\n\ton", "你好 😀", "x" * 3000, "lorem ipsum " * 2000, "▁"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 1), (None, "abc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    out = ps.sample_pieces(docs, MODEL, 2)
    found = out.collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        for r in by_id[i]:
            assert library.decode(r["ids"]) == (text or "").replace("▁", " ")
            assert r["round_trip"] == (i != 8) and r["n_pieces"] == len(r["ids"])
    assert len(by_id[0]) == len(by_id[1]) == 1 and by_id[0][0]["ids"] == [] and by_id[0][0]["log_inclusion"] == 0
    assert len(by_id[4]) == 4 and len({tuple(r["ids"]) for r in by_id[4]}) == 2
    assert len(by_id[None]) == 2
    decoded = ps.decode_pieces(out, MODEL).collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in decoded if r["doc_id"] not in (None, 8))
    assert ps.sample_pieces(docs.limit(0), MODEL).collect() == []
