"""Literal pipelines with known answers."""

import importlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import AggFunction, is_blank, shift_char, to_type
from tessera.plans import pagerank
from tessera.plans.queries import QUERIES
from tessera.sources import SplitSource

AGES3 = [("hp", 18), ("hp1", 19), ("hp2", 20)]
AGES4 = [("hp", 8), ("hp", 10), ("hp1", 19), ("hp2", 20)]
JOIN_L, JOIN_R = [("hp", 1), ("hp", 1), ("hp1", 1)], [("hp", 2), ("hp1", 2), ("hp2", 2)]
REDUCE4 = [("hp", 2), ("hp1", 19), ("hp2", 21), ("hp", 18)]
SELF4 = [("hp", 8, 8), ("hp", 8, 10), ("hp", 10, 8), ("hp", 10, 10), ("hp1", 19, 19), ("hp2", 20, 20)]


def flat(joined):
    return sorted(((k, v.left, v.right) for k, v in joined.collect()), key=str)


def same(joined, want):
    assert flat(joined) == sorted(want, key=str)


def test_map_filter_flatmap(ctx):
    strs = ctx.make_dataset(["1", "2", "3"], 4)
    assert sorted(strs.map(lambda v: v.cast("int")).collect()) == [1, 2, 3]
    letters = ctx.make_dataset(list("abcde"))
    moved = letters.map(shift_char).filter(lambda v: F.ascii(v) > 0)
    assert sorted(moved.collect()) == list("bcdef")
    assert sorted(letters.flat_map(lambda v: F.array(shift_char(v))).collect()) == list("bcdef")
    assert sorted(letters.map_python(lambda v: chr(ord(v) + 1), "string").collect()) == list("bcdef")


def test_zip_with_index_and_partition_limit(ctx):
    letters = ctx.make_dataset(list("abcde"))
    assert sorted(r["index"] for r in letters.zip_with_index().collect()) == [0, 1, 2, 3, 4]
    by = letters.df.repartition(3)
    rows = ctx.from_frame(by).zip_with_index(order_by=["value"]).collect()
    assert sorted((r["index"], r["value"]) for r in rows) == list(enumerate("abcde"))
    assert ctx.empty().zip_with_index().collect() == []
    assert len(ctx.from_frame(by).partition_limit(1).collect()) <= 3


def test_grouped_api(ctx):
    dups = ctx.make_dataset(["a", "a", "b", "b", "b"], 2).group_by(lambda v: F.ascii(v) % 2)
    assert dict(dups.reduce_groups_python(lambda a, b: a + b, "string").collect()) == {0: "bbb", 1: "aa"}
    assert sorted(dups.map_groups_python(lambda k, rows: "".join(rows), "string").collect()) == ["aa", "bbb"]
    assert dict(dups.reduce_groups("max").collect()) == {0: "b", 1: "a"}
    assert sorted(dups.map_groups(F.count).collect()) == [2, 3]


def test_reduce_by_key(ctx):
    data = ctx.make_kv(REDUCE4, 3)
    assert data.reduce_by_key("sum").collect_map() == {"hp": 20, "hp1": 19, "hp2": 21}
    assert data.reduce_by_key_python(lambda a, b: a + b).collect_map() == {"hp": 20, "hp1": 19, "hp2": 21}
    assert data.count_by_key().collect_map() == {"hp": 2, "hp1": 1, "hp2": 1}
    assert data.avg_values().collect_map() == {"hp": 10.0, "hp1": 19.0, "hp2": 21.0}
    assert len(data.reduce_by_key("sum").limit(2).collect()) == 2
    assert data.reduce_by_key("sum", 2).collect_map() == {"hp": 20, "hp1": 19, "hp2": 21}


def test_division_by_zero_raises(ctx):
    bad = ctx.make_kv(AGES4).map_values(lambda v: F.expr("value div 0")).reduce_by_key("sum")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        bad.collect()


def test_sorts(ctx):
    data = ctx.make_kv([("hp1", 19), ("hp", 8), ("hp", 10), ("hp2", 20)], 2)
    want = [("hp2", 20), ("hp1", 19), ("hp", 10), ("hp", 8)]
    assert data.sort_by_value(ascending=False).collect() == want
    assert data.sort_by_value(ascending=False, partitions=2).collect() == want
    assert [k for k, _ in data.sort_by_key_python(lambda a, b: (a < b) - (a > b)).collect()] == ["hp2", "hp1", "hp", "hp"]
    few = ctx.from_frame(data.df.filter("value > 19").repartition(4)).to_keyed()
    assert few.sort_by_key().collect() == [("hp2", 20)]
    nulls = ctx.make_kv([(None, 1), ("a", 2)], key_type="string")
    assert [k for k, _ in nulls.sort_by_key().collect()] == [None, "a"]
    assert [k for k, _ in nulls.sort_by_key(ascending=False).collect()] == ["a", None]


def test_random_sums(ctx):
    digits = "03234441334323242214120444332204013040040022220302"
    data = ctx.make_kv([(f"a{d}", i % 5) for i, d in enumerate(digits)])
    assert data.reduce_by_key("sum").collect_map() == {"a0": 14, "a1": 8, "a2": 32, "a3": 24, "a4": 22}


def test_joins(ctx):
    left, right = ctx.make_kv(JOIN_L), ctx.make_kv(JOIN_R)
    inner = [("hp", 1, 2), ("hp", 1, 2), ("hp1", 1, 2)]
    same(left.join(right), inner)
    same(left.right_join(right), [*inner, ("hp2", None, 2)])
    same(left.left_join(right), inner)
    same(ctx.make_kv([*JOIN_L, ("hp3", 1)]).full_join(right), [*inner, ("hp2", None, 2), ("hp3", 1, None)])


def test_self_joins(ctx):
    ages3, ages4 = ctx.make_kv(AGES3), ctx.make_kv(AGES4)
    same(ages3.distinct().join(ages3.distinct()), [(k, v, v) for k, v in AGES3])
    same(ages4.join(ages4), SELF4)
    same(ages4.map_values(lambda v: v).join(ages4.map_values(lambda v: v)), SELF4)
    dealt = ages4.repartition_by_key(2)
    same(dealt.join(dealt.map_values(lambda v: v)), SELF4)
    sums = ages4.reduce_by_key("sum")
    same(sums.join(sums), [("hp", 18, 18), ("hp1", 19, 19), ("hp2", 20, 20)])
    grouped = ages4.group_by_key().cache()
    assert grouped.map_values(lambda v: F.lit(1)).join(grouped).count() == 3
    same(ages3.map_keys(lambda k: k).join(ages3), [(k, v, v) for k, v in AGES3])


def test_join_of_lists(ctx):
    left = ctx.make_kv([(1, "v1_1"), (2, "v1_2_1"), (2, "v1_2_2"), (7, "v1_7"), (8, "v1_8")])
    right = ctx.make_kv([(2, "v2_2"), (4, "v2_4"), (7, "v2_7_1"), (7, "v2_7_2"), (8, "v2_8"), (9, "v2_9")])
    same(left.join(right), [(2, "v1_2_1", "v2_2"), (2, "v1_2_2", "v2_2"), (7, "v1_7", "v2_7_1"), (7, "v1_7", "v2_7_2"), (8, "v1_8", "v2_8")])


def test_unions(ctx):
    a, b = ctx.make_kv([("hp", 18)]), ctx.make_kv([("hp1", 20)])
    assert sorted(a.union(b).collect()) == [("hp", 18), ("hp1", 20)]
    first = ctx.make_kv([("hp", 8), ("hp", 10)]).reduce_by_key("sum")
    second = ctx.make_kv([("hp", 2), ("hp1", 19), ("hp2", 21)]).reduce_by_key("sum")
    assert first.union_all(second).reduce_by_key("sum").collect_map() == {"hp": 20, "hp1": 19, "hp2": 21}
    third = ctx.make_kv([("hp", 18), ("hp2", 21)]).reduce_by_key("sum")
    assert sorted(first.union(third).collect()) == [("hp", 18), ("hp2", 21)]
    assert sorted(a.union_all(a).collect()) == [("hp", 18)] * 2


def test_standard_answers_in_corner_cases(ctx):
    same(ctx.make_kv([("a", 1), ("a", 2)]).left_join(ctx.make_kv([("b", 9)])), [("a", 1, None), ("a", 2, None)])
    same(ctx.make_kv([("b", 1), ("a", 1)]).join(ctx.make_kv([("a", 2), ("b", 2)])), [("a", 1, 2), ("b", 1, 2)])
    whole = ctx.make_kv(AGES4)
    assert whole.left_join(whole.filter(lambda k, v: v > 18)).count() == 4
    nulls = ctx.make_kv([(None, 1), (None, 2), ("a", 3)], key_type="string")
    assert nulls.reduce_by_key("sum").collect_map() == {None: 3, "a": 3}
    same(nulls.join(nulls), [("a", 3, 3)])
    with pytest.raises(ValueError, match="duplicate"):
        whole.collect_map()
    assert ctx.empty("value long").reduce("sum") is None
    assert ctx.empty("value long").reduce_python(lambda a, b: a + b) is None


def test_left_join_with_missing_city(ctx):
    cities = ctx.make_kv([("hp", "xi'an"), ("hp1", "chengdu")])
    same(ctx.make_kv(AGES4).reduce_by_key("sum").left_join(cities), [("hp", 18, "xi'an"), ("hp1", 19, "chengdu"), ("hp2", 20, None)])


def test_cache(ctx):
    data = ctx.make_dataset(["1", "2", "3"]).cache()
    assert data.df.storageLevel.useMemory
    assert sorted(data.collect()) == ["1", "2", "3"]
    data.uncache()
    assert not data.df.storageLevel.useMemory
    with pytest.raises(ValueError, match="cache mode"):
        data.cache("TAPE")


def test_join_queries_take_whole_tables(spark, tmp_path):
    customers = [(1, 10), (2, 20), (3, 30), (4, 40), (6, 60)]
    orders = [(1, 100), (1, 101), (2, 102), (3, 103), (6, 104), (6, 105), (7, 106), (8, 107)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    both = [(1, 10, 100), (1, 10, 101), (2, 20, 102), (3, 30, 103), (6, 60, 104), (6, 60, 105)]
    left, right = [(4, 40, None)], [(7, None, 106), (8, None, 107)]
    for name, want in {"inner_join": both, "left_join": both + left, "right_join": both + right, "full_join": both + left + right}.items():
        assert sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str), name


EDGES6 = [(1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 1)]


def test_pagerank_fixed_point(spark):
    edges = spark.createDataFrame(EDGES6, "src int, dst int").coalesce(1)
    ranks = {r["node"]: r["rank"] for r in pagerank(edges, 150).collect()}
    assert set(ranks) == {1, 2, 3, 4}
    assert abs(ranks[1] - 1.918918918918918) < 1e-7
    assert all(abs(ranks[i] - 0.6936936936936938) < 1e-7 for i in (2, 3, 4))


def test_pagerank_has_partitions_by_the_number_of_edges(spark, monkeypatch):
    """A task's memory used to grow with the edges, as their number of partitions did not."""
    module, pairs = importlib.import_module("tessera.plans.pagerank"), [(i % 20, (i * 7) % 50) for i in range(100)]
    edges = spark.createDataFrame([*pairs, *pairs, (None, 3), (4, None)], "src int, dst int")
    rounded = lambda ranks: sorted(((r["node"], round(r["rank"], 9)) for r in ranks.collect()), key=str)
    want = rounded(pagerank(edges, 2))
    parts, cache = [], type(edges).cache

    def spied(df):
        parts.append(df.rdd.getNumPartitions())
        return cache(df)

    monkeypatch.setattr(type(edges), "cache", spied)
    monkeypatch.setattr(module, "EDGES", 10, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = pagerank(edges, 2)
    assert parts == [21]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert rounded(found) == want
    assert pagerank(edges.limit(0), 2).collect() == []


def test_pagerank_query_runs_on_all_ids(spark, tmp_path):
    rows = [(1, 51), (51, 1), (1, 101), (1, 51), (101, 1), (2, 2), (50, 100), (7, 250), (51, 250)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {e for s, p in rows for e in ((("s", s), ("p", p)), (("p", p), ("s", s)))}
    nodes = {x for x, _ in edges}
    ranks = dict.fromkeys(nodes, 1.0)
    for _ in range(3):
        ranks = {x: 0.15 + 0.85 * sum(ranks[s] / sum(s == a for a, _ in edges) for s, t in edges if t == x) for x in nodes}
    found = {r["node"]: r["rank"] for r in QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    assert found == {2 * i + (kind == "p"): pytest.approx(rank, abs=1e-6) for (kind, i), rank in ranks.items()}


def test_text_and_adjacency(ctx, tmp_path):
    (tmp_path / "a.txt").write_text("x y\n\nz")
    (tmp_path / "empty.txt").write_text("")
    assert sorted(ctx.text_file(str(tmp_path)).collect()) == ["", "x y", "z"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ctx.text_file(str(tmp_path / "none"))
    (tmp_path / "g.txt").write_text("1 2\n\n0\n")
    assert sorted(ctx.adjacency_file(str(tmp_path / "g.txt")).collect()) == [(0, [1, 2]), (2, [0])]


class Boom(SplitSource):
    def schema(self):
        return "x long"

    def splits(self):
        return []

    def read(self, split):
        yield (1,)


def test_source_without_splits(ctx):
    assert ctx.from_source(Boom()).collect() == []


def test_user_aggregate_and_actions(ctx):
    class Mean(AggFunction):
        def zero(self):
            return (0, 0)

        def add(self, state, row):
            return (state[0] + row, state[1] + 1)

        def merge(self, left, right):
            return (left[0] + right[0], left[1] + right[1])

        def value(self, state):
            return state[0] / state[1]

    data = ctx.make_kv(REDUCE4)
    assert data.aggregate_by_key_python(Mean(), "double").collect_map() == {"hp": 10.0, "hp1": 19.0, "hp2": 21.0}
    nums = ctx.make_dataset(list(range(100)), 4)
    assert nums.reduce("sum") == nums.reduce_python(lambda a, b: a + b) == 4950
    assert sum(nums.run_job(lambda rows: sum(1 for _ in rows))) == 100
    with pytest.raises(Exception, match="returned None"):
        nums.map_partition_python(lambda rows: None, "long").collect()


def test_captured_state_is_copied(ctx):
    add = [1]
    moved = ctx.make_dataset([1, 2]).map_python(lambda v: v + add[0], "long")
    add[0] = 100
    assert sorted(moved.collect()) == [2, 3]


def test_types(ctx):
    maps = ctx.make_dataset([{"weight": 1, "height": 2, "ss": None}, None], dtype="map<string,int>")
    assert {"weight": 1, "height": 2, "ss": None} in maps.collect() and None in maps.collect()
    assert to_type("varlong").simpleString() == "bigint"
    assert ctx.make_dataset([" \t", "x"]).filter(lambda v: is_blank(v)).count() == 1


def test_laws(ctx):
    rng = random.Random(7)
    left = ctx.make_kv([(rng.randrange(8), rng.randrange(5)) for _ in range(60)], 3)
    right = ctx.make_kv([(rng.randrange(4, 12), rng.randrange(5)) for _ in range(40)], 2)
    assert sorted(left.union(right).collect()) == sorted(left.union_all(right).distinct().collect())
    inner, outer = flat(left.join(right)), flat(left.left_join(right))
    assert [x for x in outer if x[2] is not None] == inner
    sums = left.reduce_by_key("sum").collect_map()
    assert sums == {k: sum(v) for k, v in left.group_by_key().collect()}


def test_stream_fold(spark, tmp_path):
    from tessera.streaming import fold_by_key

    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").parquet(str(tmp_path / "in"))
    totals = fold_by_key(stream, "k", "v", "long", lambda s, x: s.update(s.state + int(x)), 0)
    run = totals.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {r["key"]: r["state"] for r in spark.table("folded").collect()} == {"a": 4, "b": 2}


def test_library_does_not_import_llm():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(top, "tessera")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "tessera.llm" not in f.read()


def test_a_state_may_be_any_value(ctx):
    folded = ctx.make_kv([("k", "__nothing__"), ("k", "x")], 1).reduce_by_key_python(lambda a, b: min(a, b) + max(a, b))
    assert folded.collect() == [("k", "__nothing__x")]


def test_a_cluster_must_name_its_checkpoint_folder():
    from tessera.checkpoints import ensure_checkpoint_dir

    class Cluster:
        master = "spark://host:7077"
        sparkContext = conf = property(lambda self: self)  # noqa: N815
        getCheckpointDir = lambda self: None  # noqa: E731, N815
        get = lambda self, key, default=None: default

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Cluster())
