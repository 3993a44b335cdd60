"""The pipeline's stages, each on its own input, against brute-force versions."""

import os
import random
import time

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_native_operators import brute_contained, edits
from test_parity_join import brute_sets

from tessera.llm.common import checkpointed, ensure_checkpoint_dir, materialized
from tessera.llm.quality_rules import judge_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        found = spark.read.parquet(path)
        out.append(({r["doc_id"]: r for r in docs.collect()}, found.collect(), found))
        docs = found
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(frame.dtypes == want for _, _, frame in stages[:-1])
    assert all(0 < len(rows) <= len(before) for before, rows, _ in stages[:-1])


def test_quality(spark, stages):
    before, rows, _ = stages[0]
    judged = judge_quality(spark.createDataFrame([(i, r["text"]) for i, r in before.items()], "doc_id long, text string"))
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in judged.filter("kept").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()
    kept = {r["doc_id"] for r in rows}
    bad = [r["doc_id"] for r in labels if r["q"] == 0]
    assert not kept.intersection(bad)


def test_lines(stages):
    before, rows, _ = stages[1]
    lines = sorted((d, p, x) for d, r in before.items() for p, x in enumerate(r["text"].split("\n")) if len(x) >= 20)
    first = {}
    for d, p, x in lines:
        first.setdefault(x, (d, p))
    by_size = {}
    for x in first:
        by_size.setdefault(len(x), []).append(x)
    near = set()
    for x in (x for x in first if len(x) >= 40):
        for y in (y for n in range(len(x) - 2, len(x) + 3) if n >= 40 for y in by_size.get(n, ()) if first[y] < first[x]):
            # Two edits leave one of three thirds in one piece, moved by two places at most.
            third = len(x) // 3
            if any(x[i * third : (i + 1) * third] in y for i in range(3)) and edits(x, y) <= 2:
                near.add(x)
                break
    want = {}
    for d, r in before.items():
        text = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if len(x) < 20 or (first[x] == (d, p) and x not in near))
        if text == r["text"] or (text.strip() and 5 * len(text) >= len(r["text"])):
            want[d] = text
    assert {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_near_duplicates(stages):
    before, rows, _ = stages[2]
    sets = {d: brute_sets(r["text"], 5) for d, r in before.items()}
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["doc_id"] for r in rows} == {d for d in label if label[d] == d}


def test_decontamination(spark, stages):
    before, rows, _ = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute_contained([(d, r["text"]) for d, r in before.items()], items)}
    assert {r["doc_id"] for r in rows} == set(before) - bad


def test_segmentations(stages):
    import public_tokenizers

    before, rows, _ = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"] for r in rows} == set(before)
    assert all(library.decode(r["ids"]) == before[r["doc_id"]]["text"] and r["round_trip"] for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows)


def test_run_gives_the_rows_of_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in found) == sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in stages[4][1])


def test_near_copies_leave_no_scraps(spark):
    """Of planted near copies, the lines and the near-duplicate stage together leave at most a tenth."""
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(12))
    rows, copies = [], set()
    for group in range(30):
        lines = [line() for _ in range(12)]
        rows.append((group * 10, "\n".join(lines)))
        for k in range(1, 4):
            changed = list(lines)
            changed[rng.randrange(12)] = line()
            rows.append((group * 10 + k, "\n".join(changed)))
            copies.add(group * 10 + k)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.line_dedup(spark, docs, SF), SF).collect()
    ids = {r["doc_id"] for r in left}
    assert ids >= {i for i, _ in rows} - copies
    assert len(ids & copies) <= 0.1 * len(copies)


def test_stages_delete_what_is_not_read_again(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), tables()
    lines = corpus_pipeline.line_dedup(spark, docs, SF)
    assert len(tables() - before) == 1  # the kept lines' numbers; the lines, their keys and pairs are gone
    assert lines.count() > 0
    before = tables()
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert len(tables() - before) == 4  # sets, their facts and two tables of links
    assert near.count() > 0


@pytest.mark.parametrize("write", [checkpointed, materialized])
def test_written_rows_free_their_shuffles(spark, write):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    rows = write(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).count())
    for _ in range(50):  # files are deleted a little after the query
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert rows.count() == 50_000


CLASHING = ["a.b", "row", "id", "kept", "held", "gone", "lines", "text_", "__row", "__features"]


@pytest.fixture(scope="module")
def corners(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns named as helpers are."""
    rng = random.Random(8)
    good = lambda n: "\n".join(" ".join(rng.choice("the of and to in is that for it was on are with as they be at one have this".split()) + rng.choice(["", "ly", "ing", "ed", "er"]) + str(k % 7) for k in range(12)) + "." for _ in range(n))
    text = good(8)
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, " \n\t\n "), (None, text), (None, None), (6, good(900)), (7, "w" * 60_000), (8, good(8)), (8, good(6)), (9, "one two"), (-3, good(5))]
    schema = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{c}` string" for c in CLASHING]]
    frame = spark.createDataFrame([(i, t, None, "s" if i else None, len(t) if t else None, *[None if i == 9 else c for c in CLASHING]) for i, t in rows], ", ".join(schema))
    return frame, rows


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(frame, *columns):
    return sorted(([r[c] for c in columns] for r in frame.collect()), key=str)


def test_quality_on_corner_cases(spark, corners):
    docs, rows = corners
    found = stage_of("quality_rules")(spark, docs, SF)
    assert found.dtypes == docs.dtypes
    judged = judge_quality(docs).filter("kept")
    assert rows_of(found, "doc_id") == rows_of(judged, "doc_id")
    assert not {3, 4, 5, 9} & {r["doc_id"] for r in found.collect()}


def test_lines_on_corner_cases(spark, corners):
    docs, rows = corners
    found = stage_of("line_dedup")(spark, docs, SF)
    assert found.columns == docs.columns
    texts = rows_of(found, "doc_id", "text")
    # Rows of one id are no copies of each other, rows without an id are left alone, of a later copy nothing is left.
    assert texts == sorted(([i, t] for i, t in rows if i != 2), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["a.b"] == (None if r["doc_id"] == 9 else "a.b") for r in found.collect())


def test_near_duplicates_on_corner_cases(spark, corners):
    docs, rows = corners
    found = stage_of("near_duplicates")(spark, docs, SF)
    assert found.dtypes == docs.dtypes
    assert rows_of(found, "doc_id", "text") == sorted(([i, t] for i, t in rows if i != 2), key=str)


def test_decontamination_on_corner_cases(spark, corners):
    docs, rows = corners
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").orderBy(F.char_length("text").desc()).first()["text"]
    bad = docs.filter("doc_id = 9").withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit(f"so {item} it is"))
    both = docs.unionAll(bad).unionAll(bad)
    found = stage_of("benchmark_decontamination")(spark, both, SF)
    assert found.dtypes == docs.dtypes
    assert rows_of(found, "doc_id", "text") == sorted(([i, t] for i, t in rows), key=str)


def test_segmentations_on_corner_cases(spark, corners):
    docs, rows = corners
    found = stage_of("sentencepiece")(spark, docs, SF).collect()
    assert all(r["round_trip"] for r in found)
    first = sorted(str(r["doc_id"]) for r in found if r["sample"] == 0)
    assert first == sorted(str(i) for i, _ in rows)
    assert all(r["ids"] == [] for r in found if r["doc_id"] in (3, 4))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, corners, name):
    docs = corners[0].limit(0)
    found = stage_of(name)(spark, docs, SF)
    assert found.count() == 0
    assert name == "sentencepiece" or found.columns == docs.columns
