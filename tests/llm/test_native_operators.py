"""Decontamination, line dedup and chat formatting against brute force, and their plans hold no Python."""

import itertools
import random
import re

import pytest

from tessera.llm import chat_format, common, decontamination, line_dedup

DOC = "doc_id long, text string, source string"
ITEM = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute_contained(docs, items):
    best = {}
    for d, text in docs:
        for i, item in items:
            q = words(item)
            if not q:
                continue
            n = min(5, len(q))
            s = shingles(q, n)
            held = len(s & shingles(words(text), n))
            if held >= 0.8 * len(s) - 1e-9:
                best[d, i] = max(best.get((d, i), (0,)), (held / len(s), len(s), held))
    return sorted(((d, i, s, h, round(c, 9)) for (d, i), (c, s, h) in best.items()), key=str)


def contamination_case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 20, 40])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "  \n "), (None, "alpha beta gamma delta epsilon zeta"), (3, items[3][1]), (3, "another text under the same id")]
    docs = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            piece = words(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                if piece:
                    piece[rng.randrange(len(piece))] = "changed"
            body[len(body) // 2 : len(body) // 2] = piece
        docs.append((i, " ".join(body).upper() if i % 7 == 0 else "\n".join(body)))
    docs += [(60, None), (61, ""), (62, "x"), (None, "so alpha beta gamma delta epsilon zeta it is"), (5, docs[5][1]), (63, "q " * 20_000 + items[5][1])]
    return docs, items


@pytest.fixture(params=["broadcast", "shuffle"])
def sized(request, monkeypatch):
    """Once with the small sides broadcast, once as if none were small."""
    if request.param == "shuffle":
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)


def test_contained_items_equal_brute_force(spark, sized):
    docs, items = contamination_case()
    frame = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, item_id string")
    found = decontamination.contained_items(frame, spark.createDataFrame(items, ITEM)).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"], round(r["containment"], 9)) for r in found), key=str) == brute_contained(docs, items)
    kept = decontamination.decontaminate(frame, spark.createDataFrame(items, ITEM))
    bad = {d for d, *_ in brute_contained(docs, items)}
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "s")], DOC), spark.createDataFrame([], ITEM)
    assert decontamination.contained_items(docs, items).collect() == []
    assert decontamination.decontaminate(docs, items).count() == 1
    assert decontamination.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEM)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(chars) or 1), rng.randrange(3) if chars else 1
        if kind == 0:
            chars[at] = rng.choice("abcé你 ")
        elif kind == 1:
            chars.insert(at, rng.choice("abcé你 "))
        else:
            del chars[at]
    return "".join(chars)


def line_case():
    rng = random.Random(11)
    base = ["".join(rng.choice("abc dé") for _ in range(rng.randrange(15, 90))) for _ in range(25)]
    docs = []
    for i in range(40):
        docs.append((i, "\n".join(mutated(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(8)))))
    docs += [(-7, base[1] + "x\n" + base[2]), (40, None), (41, ""), (42, "\n\n"), (43, " " * 50 + "\n" + " " * 50), (None, base[0]), (3, docs[3][1]), (44, "z" * 30_000), (45, "z" * 30_001 + "\nshort\nshort"), (46, "same line that is long enough to count here\n" * 400)]
    return docs


def brute_dropped(docs, most):
    lines = [(d, p, x) for d, t in docs if t is not None and d is not None for p, x in enumerate(t.split("\n")) if len(x) >= 20 and re.search(r"[^\x20\x09-\x0D]", x)]
    first = {}
    for d, p, x in lines:
        first[x] = min(first.get(x, (d, p)), (d, p))
    near = set()
    for (x, a), (y, b) in itertools.combinations(first.items(), 2):
        if min(len(x), len(y)) >= 40 and abs(len(x) - len(y)) <= most and (min(len(x), len(y)) > 5000 and x in y or max(len(x), len(y)) < 5000 and edits(x, y) <= most):
            near.add(x if a > b else y)
    kept = {first[x] for x in first if x not in near}
    return [[p for p, x in enumerate((t or "").split("\n")) if d is not None and len(x) >= 20 and re.search(r"[^\x20\x09-\x0D]", x) and (d, p) not in kept] for d, t in docs]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, most, sized):
    docs = line_case()
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, pos int")
    want = brute_dropped(docs, most)
    found = line_dedup.dropped_lines(frame, edits=most).collect()
    assert sorted(((r["doc_id"], r["dropped"]) for r in found), key=str) == sorted(((d, x) for (d, _), x in zip(docs, want, strict=True)), key=str)
    assert all(r["n_dropped"] == len(r["dropped"]) for r in found)
    cleaned = line_dedup.dedup_lines(frame, edits=most)
    assert cleaned.columns == frame.columns
    for r in cleaned.collect():
        text = docs[r["pos"]][1]
        stays = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in want[r["pos"]])
        assert r["text"] == stays
    assert line_dedup.dropped_lines(frame.limit(0)).collect() == []
    assert line_dedup.dedup_lines(frame.limit(0)).collect() == []


def test_line_dedup_drops_lines_two_edits_away(spark):
    line = "a line of more than forty characters, the first of all"
    docs = [(1, line), (2, line.replace("forty", "fxrty").replace("first", "fxrst")), (3, line.replace("line", "lne").replace("all", "al")), (4, line.replace("forty", "fxrtx").replace("first", "fxrst"))]
    found = line_dedup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # The last line is three edits from the first, but one from the second, which is dropped and still counts as earlier.
    assert {r["doc_id"]: r["dropped"] for r in found} == {1: [], 2: [0], 3: [0], 4: [0]}
    assert {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(spark.createDataFrame([docs[0], docs[3]], "doc_id long, text string")).collect()} == {1: [], 4: []}


def test_line_keys_are_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes."""
    firsts = spark.range(4).selectExpr("cast(id as decimal(31, 0)) as at", "repeat(concat('line ', id), 10) as line")
    stages = line_dedup.keyed_lines(firsts, 40, 2)._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())) <= 8000


def test_line_dedup_counts_code_points(spark):
    """Lines of characters beyond the basic plane, and of bytes that are no UTF-8."""
    wide = "".join(chr(0x1F600 + k % 60) for k in range(42))
    docs = [(1, wide), (2, "x" + wide[:20] + wide[21:]), (3, "xyz" + wide[3:]), (4, "xy" + wide[:30] + "z" + wide[31:]), (5, wide[:39])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    broken = spark.sql("select id as doc_id, cast(concat(X'eda080ff', cast(concat(repeat('broken ', 8), if(id = 7, 'ab', 'cd'), if(id = 8, 'efg', '')) as binary)) as string) as text from range(6, 9)")
    found = {r["doc_id"]: r["dropped"] for r in line_dedup.dropped_lines(frame.unionAll(broken)).collect()}
    assert found == {1: [], 2: [0], 3: [], 4: [], 5: [], 6: [], 7: [0], 8: []}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_automaton_equals_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("你好", "你")]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        pairs.append((a, mutated(rng, a, rng.randrange(5)) if a and rng.random() < 0.8 else "".join(rng.choice("abé") for _ in range(rng.randrange(12)))))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", line_dedup.within_edits(frame["a"], frame["b"], k).alias("near")).collect():
        assert r["near"] == (edits(r["a"], r["b"]) <= k), (r["a"], r["b"])


CONV = "conv_id long, turn long, role string, text string, part int"


def test_chat_threads_follow_quotes(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nIt never rises.", 0),
        (1, 1, "assistant", "Use fresh yeast.", 0),
        (1, 2, "user", "On Monday, A wrote:\n> how do I  bake *bread*?\n\nSee also the other thread.", 0),
        (1, 3, "user", ">> How do I bake bread?\n> See also the other thread.\nWhich one?", 0),
        (1, 4, "assistant", "> Use fresh yeast.\n> > old words\n\nIt worked", 0),
        (1, 5, None, "> nobody said this\nHm <|end|>", 0),
        (1, 6, "user", "> Use fresh yeast.", 0),
        (2, 0, "user", None, 0), (2, 1, "assistant", "Hello", 0), (2, 1, "assistant", "Hello", 0), (None, 0, "user", "lost", 0), (3, None, "user", "when", 0),
    ]
    frame = spark.createDataFrame(rows, CONV)
    linked = {(r["conv_id"], r["turn"]): r for r in chat_format.linked_messages(frame).collect()}
    assert [linked[1, i]["parent"] for i in range(7)] == [None, None, 0, 2, 1, None, 1]
    assert [linked[1, i]["root"] for i in range(7)] == [0, 1, 0, 0, 1, 5, 1]
    assert linked[1, 2]["text"] == "See also the other thread."
    out = {(r["conv_id"], r["part"]): r for r in chat_format.format_conversations(frame).collect()}
    text = out[1, 0]["text"]
    order = [text.index(x) for x in ("How do I", "See also", "Which one?", "Use fresh", "It worked", "Hm < |end|>")]
    assert order == sorted(order) and ">" not in text.replace("|>", "") and out[1, 0]["n_messages"] == 6 and out[1, 0]["n_linked"] == 3
    assert "<|unknown|>\nHm < |end|>\n<|end|>\n" in text
    assert out[2, 0]["text"] == "<|assistant|>\nHello\n<|end|>\n" and out[None, 0]["n_messages"] == 1 and out[3, 0]["n_messages"] == 1
    assert chat_format.format_conversations(frame.limit(0)).collect() == []


def test_every_quote_level_links_to_the_latest_writer(spark):
    rows = [
        (1, 0, "a", "first line here\nsecond line here\nthird line", 0), (1, 1, "b", "yes", 0), (1, 2, "a", "> yes\nok", 0), (1, 3, "b", "yes", 0), (1, 4, "c", "> yes\nthen", 0),
        (1, 5, "c", ">> second line here\n>> third line\n> nothing known\nwell", 0), (1, 6, "d", ">> first line here\n> then\nfine", 0), (1, 5000, "d", "> yes\nlate", 0),
        (None, 0, "a", "yes", 0), (None, 1, "a", "> yes", 0),
    ]
    rows += [(2, i, "u", "> yes\nyes", 0) for i in range(3000)] + [(3, 0, "u", "\n".join(f"line {i} of it" for i in range(300)), 0), (3, 1, "u", "line 7 of it\nline 200 of it", 0), (3, 2, "u", "\n".join(f"> line {i} of it" for i in range(100, 290)), 0)]
    found = chat_format.messages(spark.createDataFrame(rows, CONV), "conv_id", "turn", "role", "text")
    links = {(r["conv_id"], r["turn"], r["level"]): (r["parent"], r["n"]) for r in chat_format.quote_links(found).collect()}
    # A run of several lines counts beside its single lines, so a passage in one piece outweighs scattered lines.
    assert {k: v for k, v in links.items() if k[0] == 1} == {(1, 2, 1): (1, 1), (1, 4, 1): (3, 1), (1, 5, 2): (0, 4), (1, 6, 1): (4, 1), (1, 6, 2): (0, 1), (1, 5000, 1): (3, 1)}
    assert all(links[2, i, 1] == (i - 1, 1) for i in range(1, 3000)) and (2, 0, 1) not in links
    assert links[3, 2, 1][0] == 0 and not any(k[0] is None for k in links)


def test_long_conversations_are_written_in_parts(spark):
    rows = [(1, i, "user", f"message number {i}" + (f"\n> message number {i - 1}" if i % 2 else ""), 0) for i in range(30)] + [(2, i, "user", f"m{i}", 0) for i in range(4)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, CONV), part_messages=8).collect()
    assert sorted((r["conv_id"], r["part"], r["n_messages"]) for r in out) == [(1, 0, 8), (1, 1, 8), (1, 2, 8), (1, 3, 6), (2, 0, 4)]
    text = "".join(r["text"] for r in sorted(out, key=lambda r: r["part"]) if r["conv_id"] == 1)
    assert [int(x) for x in re.findall(r"number (\d+)", text)] == list(range(30))


def test_plans_hold_no_python(spark):
    docs, items, conv = spark.createDataFrame([(1, "a b", "s")], DOC), spark.createDataFrame([(1, "a")], ITEM), spark.createDataFrame([(1, 0, "user", "x", 0)], CONV)
    for frame in (decontamination.contained_items(docs, items), line_dedup.dropped_lines(docs), line_dedup.dedup_lines(docs), chat_format.format_conversations(conv)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
