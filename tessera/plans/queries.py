"""The query catalogue: every operator as a query over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoints import ensure_checkpoint_dir
from tessera.functions import AggFunction, is_blank, java_words
from tessera.functions.exprs import shift_char
from tessera.operators.dataset import CACHE_MODES, Dataset
from tessera.operators.keyed import KeyedDataset
from tessera.plans.pagerank import pagerank
from tessera.session import Context
from tessera.sources import SplitSource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Context(spark).read_table(sf_dir, name)


def pairs(spark: SparkSession, sf_dir: str, name: str, key: str, value: str) -> KeyedDataset:
    return table(spark, sf_dir, name).key_by(lambda r: r[key], lambda r: r[value])


def out(data: Dataset, *names: str) -> DataFrame:
    return data.df.toDF(*names) if names else data.df


# ---- projections and filters ---------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as revenue from lineitem")
def map_projection(spark, d):
    return table(spark, d, "lineitem").map(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "revenue": r.l_extendedprice * (1 - r.l_discount)}).df


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_returnflag = 'R'")
def filter_predicate(spark, d):
    kept = table(spark, d, "lineitem").filter(lambda r: (r.l_quantity > 45) & (r.l_returnflag == "R"))
    return kept.map(lambda r: [r.l_orderkey, r.l_linenumber, r.l_quantity]).df


WORDS_SQL = "select unnest(string_split(lower(text), ' ')) as w from documents"


def words(spark: SparkSession, d: str) -> Dataset:
    return table(spark, d, "documents").flat_map(lambda r: java_words(r.text)).filter(lambda w: ~is_blank(w))


NOT_BLANK = r"regexp_matches(w, '[^\x00-\x20]')"


@query(f"select count(*) as n_words, count(distinct w) as n_distinct from ({WORDS_SQL}) where {NOT_BLANK}")
def flat_map_words(spark, d):
    return words(spark, d).df.agg(F.count("*").alias("n_words"), F.countDistinct("value").alias("n_distinct"))


def counted_words(spark: SparkSession, d: str) -> KeyedDataset:
    return words(spark, d).key_by(lambda w: w, lambda w: F.lit(1)).reduce_by_key("sum")


@query(f"select w as word, count(*) as n from ({WORDS_SQL}) where {NOT_BLANK} group by w")
def word_count(spark, d):
    return out(counted_words(spark, d), "word", "n")


@query(f"select w as word, count(*) as n from ({WORDS_SQL}) where {NOT_BLANK} group by w order by n desc, w limit 10")
def word_count_top10(spark, d):
    top = counted_words(spark, d).df.orderBy(F.desc("value"), "key").limit(10)
    return top.toDF("word", "n")


@query("select o_orderkey as k, o_totalprice * 2 as v from orders")
def map_values(spark, d):
    return out(pairs(spark, d, "orders", "o_orderkey", "o_totalprice").map_values(lambda v: v * 2), "k", "v")


@query("select o_custkey % 10 as k, o_orderkey as v from orders")
def map_keys(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").map_keys(lambda k: k % 10), "k", "v")


@query("select o_custkey as k, unnest(string_split(o_orderpriority, '-')) as v from orders")
def flat_map_values(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderpriority").flat_map_values(lambda v: F.split(v, "-")), "k", "v")


@query("select distinct o_custkey as k from orders")
def keys_distinct(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").keys().distinct(), "k")


@query("select distinct o_orderstatus as v from orders")
def values_distinct(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderstatus").values().distinct(), "v")


@query("select distinct o_custkey as k, o_orderstatus as v from orders")
def kv_distinct(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderstatus").distinct(), "k", "v")


@query("select o_custkey + o_orderkey as s from orders")
def kv_map(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").map(lambda k, v: k + v), "s")


@query("select n_name as k, n_nationkey as v from nation")
def to_keyed(spark, d):
    return out(table(spark, d, "nation").map(lambda r: [r.n_name, r.n_nationkey]).to_keyed(), "k", "v")


@query("select cast(n_nationkey as varchar) as v from nation")
def encoder_cast(spark, d):
    return out(table(spark, d, "nation").map(lambda r: r.n_nationkey).encoder("string"), "v")


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx from orders")
def zip_with_index(spark, d):
    keys = table(spark, d, "orders").map(lambda r: [r.o_orderkey])
    return keys.zip_with_index(order_by=["o_orderkey"], name="idx").df


@query("select count(*) as n, cast(sum(cast(l_quantity as decimal(18, 2))) as double) as qty from lineitem")
def map_partition_count(spark, d):
    def partial(rows: Iterator[float]) -> Iterator[tuple[int, float]]:
        n, total = 0, 0.0
        for qty in rows:
            n, total = n + 1, total + qty
        yield n, total

    parts = table(spark, d, "lineitem").map(lambda r: r.l_quantity).map_partition_python(partial, "n long, qty double")
    return parts.df.agg(F.sum("n").alias("n"), F.sum(F.col("qty").cast("decimal(18,2)")).cast("double").alias("qty"))


@query("select n_regionkey as p, n_name as name from nation")
def map_partition_with_id(spark, d):
    dealt = pairs(spark, d, "nation", "n_regionkey", "n_name").repartition_by_key(5, lambda k: k).values()
    return dealt.map_partition_with_id_python(lambda i, rows: ((i, name) for name in rows), "p int, name string").df.select(F.col("p").cast("long").alias("p"), "name")


@query("select n_name as name, length(n_name) as size from nation where n_regionkey <> 1")
def python_functions(spark, d):
    """The opaque 1:1, filter and 1:N functions."""
    rows = table(spark, d, "nation").map(lambda r: [r.n_name, r.n_regionkey])
    kept = rows.filter_python(lambda r: r["n_regionkey"] != 1).flat_map_python(lambda r: [r["n_name"]], "value string")
    return kept.map_python(lambda name: (name, len(name)), "name string, size long").df


@query("select k, v from (select n_regionkey * 100 + n_nationkey as k, n_name as v, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation) where i <= 2")
def partition_limit(spark, d):
    keyed = table(spark, d, "nation").key_by(lambda r: (r.n_regionkey * 100 + r.n_nationkey).cast("long"), lambda r: r.n_name)
    return out(keyed.repartition_by_key(5, lambda k: F.floor(k / 100)).partition_limit(2), "k", "v")


# ---- partitioning --------------------------------------------------------------------------


@query("select o_custkey, o_orderstatus from orders")
def repartition_rows(spark, d):
    return table(spark, d, "orders").map(lambda r: [r.o_custkey, r.o_orderstatus]).repartition(4).df


@query("select o_custkey as k, o_orderkey as v from orders")
def repartition_by_key(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").repartition_by_key(4), "k", "v")


@query("select p, count(*) as n, true as together from (select o_custkey % 3 as p from orders) group by p")
def custom_partitioner(spark, d):
    dealt = pairs(spark, d, "orders", "o_custkey", "o_orderkey").repartition_by_key(3, lambda k: F.pmod(k, F.lit(3)))
    seen = dealt.df.select(F.spark_partition_id().cast("long").alias("p"), (F.col("key") % 3 == F.spark_partition_id()).alias("ok"))
    return seen.groupBy("p").agg(F.count("*").alias("n"), F.bool_and("ok").alias("together"))


# ---- aggregations --------------------------------------------------------------------------


@query("select l_suppkey as k, cast(sum(l_linenumber) as bigint) as v from lineitem group by 1", name="reduce_by_key_sum")
def _reduce_sum(spark, d):
    return pairs(spark, d, "lineitem", "l_suppkey", "l_linenumber").reduce_by_key("sum").df.select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("select o_custkey as k, min(o_totalprice) as v from orders group by 1", name="reduce_by_key_min")
def _reduce_min(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_totalprice").reduce_by_key("min"), "k", "v")


@query("select o_custkey as k, max(o_totalprice) as v from orders group by 1", name="reduce_by_key_max")
def _reduce_max(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_totalprice").reduce_by_key("max"), "k", "v")


@query("select o_custkey as k, string_agg(o_orderstatus, '' order by o_orderstatus) as v from orders group by 1")
def reduce_by_key_concat(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderstatus").reduce_by_key("concat"), "k", "v")


@query("select n_regionkey as k, cast(sum(n_nationkey) as bigint) as v from nation group by 1")
def reduce_by_key_python(spark, d):
    data = table(spark, d, "nation").key_by(lambda r: r.n_regionkey, lambda r: r.n_nationkey.cast("long"))
    return out(data.reduce_by_key_python(lambda a, b: a + b), "k", "v")


class Spread(AggFunction):
    """Largest minus smallest value."""

    def zero(self):
        return (float("inf"), float("-inf"))

    def add(self, state, row):
        return (min(state[0], row), max(state[1], row))

    def merge(self, left, right):
        return (min(left[0], right[0]), max(left[1], right[1]))

    def value(self, state):
        return state[1] - state[0]


@query("select l_returnflag as k, max(l_quantity) - min(l_quantity) as v from lineitem group by 1")
def aggregate_function(spark, d):
    return out(pairs(spark, d, "lineitem", "l_returnflag", "l_quantity").aggregate_by_key_python(Spread(), "double"), "k", "v")


@query("select o_custkey as k, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as v from orders group by 1")
def group_by_key_list(spark, d):
    grouped = pairs(spark, d, "orders", "o_custkey", "o_orderkey").group_by_key()
    return out(grouped.map_values(lambda v: F.array_join(F.array_sort(v).cast("array<string>"), ",")), "k", "v")


@query("select max(event_id) - min(event_id) as width from events group by event_type")
def map_groups(spark, d):
    grouped = table(spark, d, "events").map(lambda r: [r.event_type, r.event_id]).group_by(lambda r: r.event_type)
    return out(grouped.map_groups(lambda row: F.max(row.event_id) - F.min(row.event_id)), "width")


@query("select event_type || ':' || count(*) as line from events group by event_type")
def map_groups_python(spark, d):
    grouped = table(spark, d, "events").map(lambda r: [r.event_type, r.event_id]).group_by(lambda r: r.event_type)
    return out(grouped.map_groups_python(lambda key, rows: f"{key}:{sum(1 for _ in rows)}", "string"), "line")


@query("select o_custkey as k, o_orderkey as v from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as r from orders) where r = 1")
def reduce_groups(spark, d):
    grouped = table(spark, d, "orders").map(lambda r: [r.o_totalprice, r.o_orderkey, r.o_custkey]).group_by(lambda r: r.o_custkey)
    best = grouped.reduce_groups("max")
    return out(best.map_values(lambda v: v.o_orderkey), "k", "v")


@query("select event_type, count(*) as n from events group by event_type")
def grouped_map_partition(spark, d):
    def count(rows: Iterator[tuple[str, Any]]) -> Iterator[tuple[str, int]]:
        last, n = None, 0
        for key, _ in rows:
            if n and key != last:
                yield last, n
                n = 0
            last, n = key, n + 1
        if n:
            yield last, n

    grouped = table(spark, d, "events").map(lambda r: [r.event_type, r.event_id]).group_by(lambda r: r.event_type)
    return grouped.map_partition_python(count, "event_type string, n long").df


@query("select l_returnflag as k, cast(sum(cast(l_quantity as decimal(18, 2))) as double) / count(l_quantity) as v from lineitem group by 1")
def avg_values(spark, d):
    return out(pairs(spark, d, "lineitem", "l_returnflag", "l_quantity").avg_values(), "k", "v")


@query("select o_custkey as k, count(*) as n from orders group by 1")
def count_by_key(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").count_by_key(), "k", "n")


@query("select max(o_totalprice) as top, count(*) as n from orders")
def global_reduce(spark, d):
    prices = table(spark, d, "orders").map(lambda r: r.o_totalprice)
    return spark.createDataFrame([(prices.reduce("max"), prices.count())], "top double, n long")


@query("select cast(sum(n_nationkey) as bigint) as total from nation")
def global_reduce_python(spark, d):
    total = table(spark, d, "nation").map(lambda r: r.n_nationkey).reduce_python(lambda a, b: a + b)
    return spark.createDataFrame([(total,)], "total long")


# ---- joins ---------------------------------------------------------------------------------

# Whole tables; the right side has as many rows to a key as a customer has orders.
SIDES = """with l as (select c_custkey as k, c_nationkey as v from customer),
r as (select o_custkey as k, o_orderkey as w from orders)"""


def sides(spark: SparkSession, d: str) -> tuple[KeyedDataset, KeyedDataset]:
    return pairs(spark, d, "customer", "c_custkey", "c_nationkey"), pairs(spark, d, "orders", "o_custkey", "o_orderkey")


def flat(joined: KeyedDataset, left: str = "v", right: str = "w") -> DataFrame:
    return joined.df.select(F.col("key").alias("k"), F.col("value.left").alias(left), F.col("value.right").alias(right))


@query(f"{SIDES} select l.k, v, w from l join r on l.k = r.k")
def inner_join(spark, d):
    left, right = sides(spark, d)
    return flat(left.join(right))


@query(f"{SIDES} select l.k, v, w from l left join r on l.k = r.k")
def left_join(spark, d):
    left, right = sides(spark, d)
    return flat(left.left_join(right))


@query(f"{SIDES} select r.k, v, w from l right join r on l.k = r.k")
def right_join(spark, d):
    left, right = sides(spark, d)
    return flat(left.right_join(right))


@query(f"{SIDES} select coalesce(l.k, r.k) as k, v, w from l full join r on l.k = r.k")
def full_join(spark, d):
    left, right = sides(spark, d)
    return flat(left.full_join(right))


@query("select a.n_regionkey as k, a.n_name as v, b.n_name as w from nation a join nation b on a.n_regionkey = b.n_regionkey")
def self_join(spark, d):
    nations = pairs(spark, d, "nation", "n_regionkey", "n_name")
    return flat(nations.join(nations))


@query("select a.n_regionkey as k, a.n_nationkey + 1 as v, b.n_nationkey * 2 as w from nation a join (select * from nation where n_nationkey > 5) b on a.n_regionkey = b.n_regionkey")
def same_lineage_join(spark, d):
    parent = pairs(spark, d, "nation", "n_regionkey", "n_nationkey").cache("MEM_DISK")
    return flat(parent.map_values(lambda v: v + 1).join(parent.filter(lambda k, v: v > 5).map_values(lambda v: v * 2)))


@query("select a.k, a.v, b.v as w from (select o_custkey as k, cast(sum(o_orderkey) as bigint) as v from orders group by 1) a join (select o_custkey as k, count(*) as v from orders group by 1) b on a.k = b.k")
def prepartitioned_join(spark, d):
    dealt = pairs(spark, d, "orders", "o_custkey", "o_orderkey").repartition_by_key(4)
    sums = dealt.reduce_by_key("sum").map_values(lambda v: v.cast("decimal(38,0)").cast("long"))
    return flat(sums.join(dealt.count_by_key()))


@query("select a.n_regionkey as k, a.n_name as v, b.r_name as w from nation a left join (select * from region where r_regionkey > 2) b on a.n_regionkey = b.r_regionkey")
def left_join_dup_unmatched(spark, d):
    regions = pairs(spark, d, "region", "r_regionkey", "r_name").filter(lambda k, v: k > 2)
    return flat(pairs(spark, d, "nation", "n_regionkey", "n_name").left_join(regions))


# ---- set operations, sorts, limits ---------------------------------------------------------


@query("select o_custkey as k from orders union all select c_custkey from customer")
def union_all(spark, d):
    a, b = table(spark, d, "orders").map(lambda r: r.o_custkey), table(spark, d, "customer").map(lambda r: r.c_custkey)
    return out(a.union_all(b), "k")


@query("select o_custkey as k from orders union select c_custkey from customer")
def union_set(spark, d):
    a, b = table(spark, d, "orders").map(lambda r: r.o_custkey), table(spark, d, "customer").map(lambda r: r.c_custkey)
    return out(a.union(b), "k")


@query("select r_name as v from region union all select r_name from region")
def union_all_self(spark, d):
    names = table(spark, d, "region").map(lambda r: r.r_name)
    return out(names.union_all(names), "v")


@query("select o_orderkey as k, o_totalprice as v, row_number() over (order by o_orderkey desc) - 1 as place from orders")
def sort_by_key_desc(spark, d):
    data = pairs(spark, d, "orders", "o_orderkey", "o_totalprice").sort_by_key(ascending=False)
    return out(data.zip_with_index(), "k", "v", "place")


@query("select o_orderkey as k, o_totalprice as v from orders")
def sort_by_value(spark, d):
    return out(pairs(spark, d, "orders", "o_orderkey", "o_totalprice").sort_by_value(ascending=False), "k", "v")


@query("select o_orderkey as k, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as place from orders")
def sort_by_value_extracted(spark, d):
    data = pairs(spark, d, "orders", "o_orderkey", "o_totalprice")
    by = data.map_values(lambda v: F.struct(v.alias("v"), (-F.col("key")).alias("k"))).sort_by_value(ascending=False)
    return out(Dataset(by.zip_with_index().df.select("key", "index")), "k", "place")


@query("select n, min(i) as first, max(i) as last from (select n, row_number() over (order by n nulls first) - 1 as i from (select nullif(c_nationkey % 7, 3) as n from customer)) group by n")
def sort_nulls_first(spark, d):
    data = table(spark, d, "customer").key_by(lambda r: F.nullif(r.c_nationkey % 7, F.lit(3)), lambda r: r.c_custkey)
    placed = data.sort_by_key().zip_with_index().df
    return placed.groupBy(F.col("key").alias("n")).agg(F.min("index").alias("first"), F.max("index").alias("last"))


@query("select n, min(i) as first, max(i) as last from (select n, row_number() over (order by n desc nulls last) - 1 as i from (select nullif(c_nationkey % 7, 3) as n from customer)) group by n")
def sort_nulls_last_descending(spark, d):
    data = table(spark, d, "customer").key_by(lambda r: F.nullif(r.c_nationkey % 7, F.lit(3)), lambda r: r.c_custkey)
    placed = data.sort_by_key(ascending=False).zip_with_index().df
    return placed.groupBy(F.col("key").alias("n")).agg(F.min("index").alias("first"), F.max("index").alias("last"))


@query("select c_custkey as k from customer order by c_custkey limit 20")
def limit_sorted(spark, d):
    return out(pairs(spark, d, "customer", "c_custkey", "c_name").sort_by_key().keys().limit(20), "k")


@query("select n_name as k, n_nationkey as v, row_number() over (order by length(n_name), n_name desc) - 1 as place from nation")
def sort_by_comparator(spark, d):
    data = pairs(spark, d, "nation", "n_name", "n_nationkey")
    longer = lambda a, b: (len(a) > len(b)) - (len(a) < len(b)) or (a < b) - (a > b)
    return out(data.sort_by_key_python(longer).zip_with_index(), "k", "v", "place")


# ---- caching, sources, iteration -----------------------------------------------------------


@query("select (select count(*) from orders where o_totalprice > 1000) as a, (select count(distinct o_custkey) from orders where o_totalprice > 1000) as b")
def cached_reuse(spark, d):
    kept = table(spark, d, "orders").filter(lambda r: r.o_totalprice > 1000).map(lambda r: [r.o_custkey]).cache("MEM_DISK")
    found = (kept.count(), kept.distinct().count())
    kept.uncache()
    return spark.createDataFrame([found], "a long, b long")


class Squares(SplitSource):
    """A connector for the custom source check: n splits of ten squares."""

    def __init__(self, n: int) -> None:
        self.n = n

    def schema(self) -> str:
        return "x long, y long"

    def splits(self):
        return list(range(self.n))

    def read(self, split):
        yield from ((i, i * i) for i in range(split * 10, split * 10 + 10))


@query("select i as x, i * i as y from range(30) t(i)")
def custom_source(spark, d):
    return Context(spark).from_source(Squares(3)).df


# Suppliers and parts are nodes of one graph: suppliers have the even numbers, parts the odd ones.
EDGES_SQL = "select distinct l_suppkey * 2 as src, l_partkey * 2 + 1 as dst from lineitem union select distinct l_partkey * 2 + 1, l_suppkey * 2 from lineitem"


def _rank_sql(rounds: int) -> str:
    parts = [f"e as ({EDGES_SQL})", "deg as (select src, count(*) as n from e group by src)", "r0 as (select src as node, cast(1 as double) as rank from deg)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} as (select e.dst as node, 0.15 + 0.85 * sum(r.rank / deg.n) as rank from e join deg on e.src = deg.src join r{i} r on r.node = e.src group by e.dst)")
    return f"with {', '.join(parts)} select node, round(rank, 6) as rank from r{rounds}"


@query(_rank_sql(3), name="pagerank")
def _pagerank(spark, d):
    supplier, part = F.col("l_suppkey") * 2, F.col("l_partkey") * 2 + 1
    both = F.array(F.struct(supplier.alias("src"), part.alias("dst")), F.struct(part.alias("src"), supplier.alias("dst")))
    edges = table(spark, d, "lineitem").df.select(F.inline(both))
    return pagerank(edges, 3).select("node", F.round("rank", 6).alias("rank"))


# ---- contexts, literal sources, files and actions -------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files/{uuid.uuid4().hex}"


@query("select c_name as line, 1 as n from customer")
def text_file(spark, d):
    path = shared_folder(spark)
    table(spark, d, "customer").map(lambda r: r.c_name).write(path, "text")
    lines = Context(spark).text_file(path, 2)
    return lines.key_by(lambda x: x, lambda x: F.lit(1)).reduce_by_key("count").df.toDF("line", "n")


@query("select n_regionkey as node, n_nationkey as target from nation")
def adjacency_file(spark, d):
    path = shared_folder(spark)
    nations = table(spark, d, "nation").df.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), " ").alias("line"))
    Dataset(nations.coalesce(1).sortWithinPartitions("n_regionkey").select("line")).write(path, "text")
    return Context(spark).adjacency_file(path).flat_map_values(lambda v: v).df.toDF("node", "target")


@query("select i as v from range(1, 101) t(i)")
def make_dataset(spark, d):
    return Context(spark).make_dataset(range(1, 101), 4, "long").df.toDF("v")


@query("select * from (values ('a', 1), ('b', 2), ('a', 3)) t(k, v)")
def make_kv(spark, d):
    return Context(spark).make_kv([("a", 1), ("b", 2), ("a", 3)], 2, "string", "int").df.toDF("k", "v")


@query("select n_name as v from nation")
def empty_union(spark, d):
    return Context(spark).empty().union_all(table(spark, d, "nation").map(lambda r: r.n_name)).df.toDF("v")


@query("select n_name as k, n_nationkey as v from nation")
def collect_map(spark, d):
    found = pairs(spark, d, "nation", "n_name", "n_nationkey").collect_map()
    return spark.createDataFrame(list(found.items()), "k string, v int")


@query("select r_name as v from region")
def collect_rows(spark, d):
    return spark.createDataFrame([(v,) for v in table(spark, d, "region").map(lambda r: r.r_name).collect()], "v string")


@query("select n_regionkey as p, count(*) as n from nation group by 1")
def run_job(spark, d):
    dealt = pairs(spark, d, "nation", "n_regionkey", "n_name").repartition_by_key(5, lambda k: k)
    sizes = Context(spark).run_job(dealt, lambda rows: sum(1 for _ in rows))
    return spark.createDataFrame(list(enumerate(sizes)), "p int, n long")


@query("select count(*) as rows, 2 * count(*) as twice from nation")
def foreach_actions(spark, d):
    rows, twice = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    data = table(spark, d, "nation").map(lambda r: r.n_name)
    data.foreach(lambda _: rows.add(1))
    data.foreach_partition(lambda part: twice.add(2 * sum(1 for _ in part)))
    return spark.createDataFrame([(rows.value, twice.value)], "rows long, twice long")


@query("select count(*) as n from supplier")
def count_rows(spark, d):
    return spark.createDataFrame([(table(spark, d, "supplier").count(),)], "n long")


@query("select o_custkey as k, o_orderkey as v from orders union all select c_custkey, c_nationkey from customer")
def pair_union_all(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").union_all(pairs(spark, d, "customer", "c_custkey", "c_nationkey")), "k", "v")


@query("select o_custkey as k, o_orderkey as v from orders")
def pair_repartition(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").repartition(3), "k", "v")


@query("select o_custkey as k, count(*) as v from orders group by 1")
def repartition_by_key_default(spark, d):
    return out(pairs(spark, d, "orders", "o_custkey", "o_orderkey").repartition_by_key().count_by_key(), "k", "v")


@query("select 7 as by_row, 3 as by_key")
def partition_counts(spark, d):
    data = pairs(spark, d, "nation", "n_regionkey", "n_name")
    return spark.createDataFrame([(data.repartition(7).num_partitions(), data.repartition_by_key(3).num_partitions())], "by_row int, by_key int")


@query("select unnest(['MEM_ONLY', 'MEM_DISK', 'DISK_ONLY']) as mode, (select count(*) from nation) as n")
def cache_modes(spark, d):
    found = []
    for mode in CACHE_MODES:
        kept = table(spark, d, "nation").map(lambda r: r.n_name).cache(mode)
        found.append((mode, kept.count()))
        kept.uncache()
    return spark.createDataFrame(found, "mode string, n long")


@query("select n_name as name, chr(ascii(n_name) + 1) as shifted, n_nationkey % 2 as odd, cast(cast(n_nationkey as varchar) as int) as parsed, trim(concat(' ', n_name)) as trimmed, substr(n_name, 2, 3) as part from nation")
def scalar_functions(spark, d):
    rows = table(spark, d, "nation").df
    parsed = F.col("n_nationkey").cast("string").cast("int")
    return rows.select(F.col("n_name").alias("name"), shift_char(F.col("n_name")).alias("shifted"), (F.col("n_nationkey") % 2).alias("odd"), parsed.alias("parsed"), F.trim(F.concat(F.lit(" "), "n_name")).alias("trimmed"), F.substring("n_name", 2, 3).alias("part"))


@query("select l_suppkey as k, max(l_quantity) as v from lineitem group by 1")
def streamed_fold(spark, d):
    """The keyed state of a stream over all rows of a table, once."""
    from tessera.streaming import fold_by_key

    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    path, name = shared_folder(spark), f"fold_{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(f"{d}/lineitem*.parquet").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("double").alias("value"))
    folded = fold_by_key(rows, "key", "value", "double", lambda at, x: at.update(max(at.state, float(x))), 0.0)
    folded.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).groupBy(F.col("key").alias("k")).agg(F.max("state").alias("v"))


# ---- the example programs ------------------------------------------------------------------


@query(f"select substr(w, 1, 1) as k, cast(sum(length(w)) as bigint) as chars, count(*) as n from ({WORDS_SQL}) where {NOT_BLANK} group by 1")
def join_demo(spark, d):
    # Both sums come from one table of distinct words, whose exchange Spark reuses.
    found = counted_words(spark, d).df
    first = F.substring("key", 1, 1).alias("key")
    counts = KeyedDataset(found.select(first, "value")).reduce_by_key("sum")
    lengths = KeyedDataset(found.select(first, (F.length("key") * F.col("value")).alias("value"))).reduce_by_key("sum")
    return flat(lengths.join(counts), "chars", "n")


@query(f"select substr(w, 1, 1) as k, round(avg(n), 9) as mean from (select w, count(*) as n from ({WORDS_SQL}) where {NOT_BLANK} group by w) group by 1")
def avg_demo(spark, d):
    means = counted_words(spark, d).map_keys(lambda k: F.substring(k, 1, 1)).avg_values()
    return out(means.map_values(lambda v: F.round(v, 9)), "k", "mean")


@query(f"select substr(w, 1, 1) as k, count(distinct w) as n from ({WORDS_SQL}) where {NOT_BLANK} group by 1")
def group_demo(spark, d):
    by_first = counted_words(spark, d).map_keys(lambda k: F.substring(k, 1, 1))
    return by_first.count_by_key().df.toDF("k", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count_top10(spark, sf_dir)
