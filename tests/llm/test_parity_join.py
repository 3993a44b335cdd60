"""The Jaccard join against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

from tessera.llm import common
from tessera.llm import parity_join as pj
from tessera.llm.components import components


def brute_sets(text, width):
    ws = (text or "").encode().lower().split()
    return frozenset([tuple(ws)] if 0 < len(ws) < width else [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)])


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, width, p, q):
    sets = [(d, brute_sets(t, width)) for d, t in docs if d is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and x and y and q * len(x & y) >= p * len(x | y)]
    label = closed({d for d, _ in sets}, links)
    return sorted((d, len(s), label[d] if s else d) for d, s in sets)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(1000)}"
        elif kind == 1:
            out.insert(at, f"new{rng.randrange(1000)}")
        elif len(out) > 1:
            del out[at]
    return out


def case(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 30, 60, 200, 900]))]
        for _ in range(rng.randrange(1, 12)):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 8]))))
    # A chain: neighbours are similar, its ends are not.
    words = [f"c{i}" for i in range(120)]
    for i in range(15):
        docs.append("\n".join(words[i * 2 :] + [f"t{j}" for j in range(i * 2)]))
    # Unlike documents with a long passage in common.
    shared = [f"p{i}" for i in range(60)]
    docs += [" ".join([f"u{k}x{i}" for i in range(25)] + shared) for k in range(30)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "width", "similarity"), [(1, 4, (85, 100)), (2, 4, (85, 100)), (3, 5, (4, 5)), (4, 1, (1, 2))])
def test_components_equal_brute_force(spark, seed, width, similarity, monkeypatch):
    if seed == 2:  # many tiles and salts, and no side small enough for a broadcast
        monkeypatch.setattr(pj, "TILE_ROWS", 3)
        monkeypatch.setattr(pj, "PARTNERS", 2)
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    docs = case(seed)
    frame = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, node long")
    found = pj.join_similar(frame, width=width, similarity=similarity).collect()
    assert sorted(map(tuple, found)) == brute(docs, width, *similarity)


def test_corner_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a"), (7, "b a"), (9, "x y z w v"), (9, "x y z w v"), (8, "X y z w v"), (10, "q w e r t y u i o p"), (10, "a b"), (None, "a b"), (None, "lone words in a row"), (11, "long " * 30_000), (12, "long " * 30_001)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int")
    found = sorted(map(tuple, pj.join_similar(frame).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 2, 8), (9, 2, 8), (9, 2, 8), (10, 7, 4), (10, 1, 4), (None, 1, 4), (None, 2, None), (11, 1, 11), (12, 1, 11)]
    assert found == sorted(want, key=str)
    kept = pj.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 11, None, None], key=str)
    assert pj.join_similar(frame.limit(0)).collect() == []
    assert pj.keep_one(frame.limit(0)).collect() == []


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    bands = pj.Bands()
    for _ in range(300):
        n = int(rng.integers(8, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, int(len(a) * 0.08))))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(np.frombuffer(pj.bit_sketch(a), np.uint8) ^ np.frombuffer(pj.bit_sketch(b), np.uint8)).sum()) <= apart
        if pj.similar(a, b) and apart:
            low = min(bands.of(len(a)), bands.of(len(b)))
            assert abs(bands.of(len(a)) - bands.of(len(b))) <= 1
            difference, words, spare = bands.shape(low)
            assert apart <= difference
            assert np.isin(pj.sketch_words(a, low, words, spare), pj.sketch_words(b, low, words, spare)).any()


def test_fine_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    told = 0
    for _ in range(300):
        n = int(rng.integers(1, 5000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, int(len(a) * 0.2))))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
        c = np.unique(rng.integers(0, 2**63, len(a)).astype(np.uint64))
        x, y, z = (np.frombuffer(pj.fine_sketch(s), np.uint64) for s in (a, b, c))
        for similarity in ((85, 100), (4, 5), (1, 2)):
            assert pj.may_be_similar(x, y, similarity) or not pj.similar(a, b, similarity)
            assert pj.may_be_similar(y, x, similarity) == pj.may_be_similar(x, y, similarity)
        told += len(a) >= 100 and pj.may_be_similar(x, z)
    assert told == 0


def test_verified_sets_are_those_of_similar_documents_in_slices(spark, monkeypatch):
    """Large unlike documents share words of their sketches; their sets used to be written and exchanged as well."""
    rng = random.Random(5)
    common_part = [f"p{i}" for i in range(900)]
    docs = [" ".join([f"u{k}x{i}" for i in range(1000)] + common_part) for k in range(30)]
    copies = [[f"c{k}x{i}" for i in range(200)] for k in range(20)]
    docs += [" ".join(edited(rng, words, 2)) for words in copies for _ in range(4)]
    docs = list(enumerate(docs))
    wanted, read = [], pj.sets_of

    def spied(rows, nodes, width):
        wanted.append({r["node"] for r in nodes.collect()})
        return read(rows, nodes, width)

    monkeypatch.setattr(pj, "sets_of", spied)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 4, 85, 100)
    assert sorted(map(tuple, pj.join_similar(frame).collect())) == want
    assert set().union(*wanted) == set(range(30, 110))
    wanted.clear()
    monkeypatch.setattr(pj, "SLICE", 0.05)
    assert sorted(map(tuple, pj.join_similar(frame).collect())) == want
    assert len(wanted) > 4
    assert all(len(nodes) < 40 for nodes in wanted)


def test_components_of_random_links(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    want = closed({x for ab in links for x in ab if ab[0] != ab[1]}, links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == want
    assert len(found) == len(want)
