"""Token counts, licence scans, quality rules and URL filters against brute force and on corner cases."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import license_scan, quality_rules, token_counts, url_filters

DOC = "doc_id long, text string"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    alphabet = ["the ", "a", "B", " ", "  ", "\n", "\t", "é", "你", "'s", "'", "12", ".", "!!", "<|endoftext|>", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", "😀"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    return ["", " ", "   ", "a  b   c ", "<|endoftext|>", "x<|endoftext|> y", "under the MIT license " * 3, "word " * 30_000, *made]


def test_piece_counts_equal_whole_text_counts():
    tokenizer = Tokenizer.from_file(BPE)
    want = [len(e) for e in tokenizer.encode_batch(texts(), add_special_tokens=False)]
    assert token_counts.TokenCounter(BPE).count(texts()) == want
    table = {" the": 1, "word": 1, " word": 1}
    assert token_counts.TokenCounter(BPE, table).count(texts()) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(name):
    counter = token_counts.TokenCounter(public_tokenizers.path(name))
    assert not counter.by_piece
    assert counter.count(["", "Hello world"])[1] > 0


def test_token_counts_query(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(0, None), (None, "abc"), (7, "abc"), (7, "abc")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, N_BYTES int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, BPE).collect()), key=str)
    n = [len(e) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted(((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True)), key=str)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), BPE).collect() == []


def brute_license(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


LICENSED = [
    "Released Under the MIT License. under the mit-license", "Apache License, Version 2.0 apache license version 2 and cc by nc", "CC BY-NC 4.0; CC BY-ND", None, "", "   ",
    "x " * 50 + license_scan.TEMPLATES[0][1] + " y" * 50, "Permission granted free copy", license_scan.TEMPLATES[4][1].replace("binary", "bin ary"),
    "This work is licensed under the GNU General Public License, version 3.", "underthemitlicense", "cc by nc cc by nc by nc", "É cc\u00a0by nc", "All rights reserved. " * 3000,
]


def test_license_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENSED)], "doc_id long, text string, labels string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for i, text in enumerate(LICENSED):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert rows[6]["labels"] == "mit" and rows[6]["base_labels"] == ""
    assert rows[9]["labels"] == "gpl-3"
    assert rows[7]["labels"] == ""
    assert rows[8]["labels"] == ""  # without its mandatory phrase a template does not count
    assert rows[13]["labels"] == "all-rights-reserved"
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


def brute_alignments(index, text):
    """Labels and coverages from every alignment of every template."""
    words = license_scan.words_of(text)
    joined, found = b" " + b" ".join(words) + b" ", {}
    slack = license_scan.SLACK
    for label, template, keys in index.templates:
        total = sum(index.idf[w] for w in template)
        for offset in range(-len(template) - slack, len(words) + slack + 1):
            near = lambda at, want, far: any(abs(i - want) <= far for i in at)
            if not all(near([i for i in range(len(words)) if joined.startswith(k, len(b" ".join(words[:i])) + bool(i))], offset, len(template) + slack) for k in keys):
                continue
            share = sum(index.idf[w] for p, w in enumerate(template) if w in words[max(0, offset + p - slack) : max(0, offset + p + slack + 1)]) / total
            if share >= license_scan.MIN_COVERAGE:
                found[label] = max(found.get(label, 0.0), min(1.0, share))
    return found


def test_license_alignments_equal_brute_force():
    rng = random.Random(5)
    for frequencies, n_docs in (({}, 10), ({"the": 90, "license": 60, "software": 3, "all": 99, "version": 20}, 100)):
        index = license_scan.LicenseIndex(frequencies, n_docs)
        held = 0
        for _ in range(120):
            words = []
            for _ in range(rng.randrange(1, 3)):
                part = rng.choice(license_scan.TEMPLATES)[1].split()
                part = [w for w in part if rng.random() > rng.choice([0, 0.05, 0.3])]
                words += part + rng.choices(["the", "software", "x", "of"], k=rng.randrange(4))
            text = " ".join(words)
            norm = b" " + b" ".join(license_scan.words_of(text)) + b" "
            got = {}
            for label, share in index._aligned(license_scan.words_of(text), norm):
                got[label] = max(got.get(label, 0.0), share)
            want = brute_alignments(index, text)
            assert got.keys() == want.keys(), text
            assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
            held += len(want)
        assert held > 50


def test_license_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "cc by nc"), (None, "cc by nc"), (3, "x"), (3, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_base"], r["base_labels"]) for r in license_scan.scan_licenses(docs).collect()), key=str)
    assert got == [(3, 0, ""), (3, 0, ""), (None, 1, "cc-by-nc"), (None, 1, "cc-by-nc")]


def test_frequent_pieces_come_from_all_partitions(spark):
    """Every task's documents are counted, however late it stands and however long they are."""
    rows = [(i, f"early{i % 7} " * 3) for i in range(40)] + [(99, "late " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    table = token_counts.frequent_pieces(docs, BPE, n=3)
    assert " late" in table and len(table) == 3
    few = token_counts.frequent_pieces(docs, BPE, n=3, reported=2, counted=4)
    assert " late" in few and all(n == token_counts.TokenCounter(BPE).count([p])[0] for p, n in (table | few).items())
    assert token_counts.frequent_pieces(docs.limit(0), BPE) == {}


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in wins if wins.count(w) > 1}
    covered = {j for i, w in enumerate(wins) if w in often for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


PROSE = "the cat and the dog of a town went to see that old house in the green wood near a river where it rained for days on end and then stopped"
QUALITY = [None, "", " \n \n", PROSE, PROSE + "\n" + PROSE, "a b c d e f " * 3, "| x # y\n| x # y\n\n", "é\u00a0ü " * 9, "x" * 50_000, PROSE.upper() + "!!", "a a a a a a", "q\x0bw\x0ce\rr"]


def test_quality_features_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(QUALITY)], "doc_id long, text string, n_words int")
    rows = {r["doc_id"]: r for r in quality_rules.judge_quality(docs).collect()}
    for i, text in enumerate(QUALITY):
        r = rows[i]
        want = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rows[3]["kept"]
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in rows.items() if r["kept"])
    assert quality_rules.judge_quality(docs.limit(0)).collect() == []
    assert quality_rules.keep_quality(docs.limit(0)).collect() == []


def test_em_finds_planted_rates():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(quality_rules.RULES)
    bad = rng.random(n) < 0.1
    votes = np.where(rng.random((n, k)) < np.where(bad[:, None], 0.4, 0.001), quality_rules.BAD, quality_rules.GOOD)
    votes[rng.random((n, k)) < 0.1] = quality_rules.ABSTAIN
    unique, counts = np.unique(votes, axis=0, return_counts=True)
    good, rates, share = quality_rules.expectation_maximisation(unique, counts.astype(float))
    assert abs(share - 0.1) < 0.02 and abs(rates[:, 1].mean() - 0.4) < 0.06
    again, _, _ = quality_rules.expectation_maximisation(unique, counts * 1000.0)
    assert np.allclose(good, again)


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/1?x=1#y", "http://www.example.com/en/", "http://www.example.com/en", "http://xexample.com/en/", "https://b.net/es/?q", "https://b.net/fr/a://b",
    "http://example.com", "http://example.com?/en/", "http://m.www.example.com/en/x", "ftp://net/es/a#/?", "http://É.example.com/en/", "x://y://z.com/", "http://a.com/" + "p/" * 5000, "http://..com/", "http://a.net:80/es/", "://com/\n/en",
]


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute_url(url)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), url
    assert url_filters.filter_urls(pages.limit(0), labels).collect() == []


def test_url_rules_are_mined_from_all_tokens(spark):
    """Ten tokens of host and path come before the query key that tells the pages apart."""
    url = "https://a.b.c.d.example.org/one/two/three/four?{}=1"
    pages = [(i, url.format("spam" if i % 2 else "page")) for i in range(80)]
    labels = [(i, 0 if i % 2 else 1, 0) for i in range(80)]
    found = url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"]: r["verdict"] for r in found} == {i: "block" if i % 2 else "allow" for i, _ in pages}


def test_url_rules_are_mined_from_labels(spark):
    pages = [(i, f"https://www.{'spam' if i % 4 == 0 else 'good'}{i % 3}.org/{'win' if i % 4 == 0 else 'read'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 400)] + [(None, 0, 0), (1, None, None)]
    found = url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"] for r in found if r["verdict"] == "block"} == set(range(0, 400, 4))


def test_pruned_rules_and_index():
    rules = [(["a"], "block", 0.9, 0.2), (["a", "b"], "block", 0.9, 0.1), (["a", "c"], "block", 0.95, 0.1), (["b"], "allow", 0.8, 0.3)]
    kept = url_filters.prune(rules)
    assert [r[0] for r in kept] == [["a"], ["b"], ["a", "c"]]
    index = url_filters.RuleIndex(kept)
    assert index.match(["c", "a"]) == ("block", 0.95) and index.match(["b"]) == ("allow", 0.8) and index.match(["z"]) is None
