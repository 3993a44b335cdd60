"""Pair datasets (key, value): key aggregations, equi-joins and sorts."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import named_reducer
from tessera.functions.types import to_type
from tessera.operators.dataset import Dataset, frozen

if TYPE_CHECKING:
    from tessera.operators.grouped import GroupedDataset



class KeyedDataset(Dataset):
    """A dataset with the columns ``key`` and ``value``. Functions over pairs get two Columns."""

    # ---- narrow transforms -------------------------------------------------------------

    def map(self, fn: Callable[[Column, Column], Any]) -> Dataset:
        return Dataset(self.df.select(*self._projection(fn(F.col("key"), F.col("value")))))

    def filter(self, fn: Callable[[Column, Column], Column]) -> KeyedDataset:
        return KeyedDataset(self.df.filter(fn(F.col("key"), F.col("value"))))

    def keys(self) -> Dataset:
        return Dataset(self.df.select(F.col("key").alias("value")))

    def values(self) -> Dataset:
        return Dataset(self.df.select(F.col("value")))

    def map_keys(self, fn: Callable[[Column], Column]) -> KeyedDataset:
        return KeyedDataset(self.df.select(fn(F.col("key")).alias("key"), F.col("value")))

    def map_values(self, fn: Callable[[Column], Column], encoder: str | T.DataType | None = None) -> KeyedDataset:
        """Keeps the partitioning by key, so a later key operation needs no second exchange."""
        out = fn(F.col("value")) if encoder is None else fn(F.col("value")).cast(to_type(encoder))
        return KeyedDataset(self.df.select(F.col("key"), out.alias("value")))

    def flat_map_values(self, fn: Callable[[Column], Column]) -> KeyedDataset:
        return KeyedDataset(self.df.select(F.col("key"), F.explode(fn(F.col("value"))).alias("value")))

    def encoder(self, key: str | T.DataType, value: str | T.DataType) -> KeyedDataset:
        return KeyedDataset(self.df.select(F.col("key").cast(to_type(key)).alias("key"), F.col("value").cast(to_type(value)).alias("value")))

    # ---- partitioning ------------------------------------------------------------------

    def repartition_by_key(self, n: int | None = None, partitioner: Callable[[Column], Column] | None = None) -> KeyedDataset:
        """Rows of a key meet in one partition, sorted by key.

        ``partitioner`` maps the key to a partition number; without one the key is hashed.
        """
        if partitioner is not None:
            dealt = self.df.repartitionById(n or self.num_partitions(), partitioner(F.col("key")).cast("int"))
        else:
            dealt = self.df.repartition("key") if n is None else self.df.repartition(n, "key")
        return KeyedDataset(dealt.sortWithinPartitions("key"))

    def _dealt(self, partitions: int | None) -> KeyedDataset:
        return self if partitions is None else KeyedDataset(self.df.repartition(partitions, "key"))

    # ---- aggregations ------------------------------------------------------------------

    def reduce_by_key(self, reducer: str | Callable[[Column], Column], partitions: int | None = None) -> KeyedDataset:
        """A named reducer or an aggregate expression; partial results are combined before the shuffle."""
        df = self.df.groupBy("key").agg(named_reducer(reducer)(F.col("value")).alias("value"))
        return KeyedDataset(df if partitions is None else df.coalesce(partitions))

    def reduce_by_key_python(self, fn: Callable[[Any, Any], Any], schema: str | None = None) -> KeyedDataset:
        """An opaque associative and commutative function, combined map-side."""
        values = self._grouped_values()
        return values.reduce_groups_python(fn, schema or self.df.schema["value"].dataType)

    def aggregate_by_key_python(self, agg: Any, schema: str) -> KeyedDataset:
        """A :class:`tessera.functions.AggFunction` over the values of each key."""
        return self._grouped_values().aggregate_python(agg, schema)

    def _grouped_values(self) -> GroupedDataset:
        from tessera.operators.grouped import GroupedDataset

        grouped = GroupedDataset(self.df.select("value"), F.col("key"))
        grouped.keyed = self.df.select(F.col("key").alias("__key"), F.col("value"))
        return grouped

    def group_by_key(self) -> KeyedDataset:
        """(key, array of values). For large groups prefer a reducer or ``map_groups_python``, which streams."""
        return KeyedDataset(self.df.groupBy("key").agg(F.collect_list("value").alias("value")))

    def avg_values(self, fn: Callable[[Column], Column] = lambda v: v, partitions: int | None = None) -> KeyedDataset:
        """Mean of ``fn(value)`` per key; nulls are skipped."""
        df = self.df.groupBy("key").agg(F.avg(fn(F.col("value")).cast("double")).alias("value"))
        return KeyedDataset(df if partitions is None else df.coalesce(partitions))

    def count_by_key(self, partitions: int | None = None) -> KeyedDataset:
        """Rows per key, lazily."""
        df = self.df.groupBy("key").agg(F.count(F.lit(1)).alias("value"))
        return KeyedDataset(df if partitions is None else df.coalesce(partitions))

    # ---- joins -------------------------------------------------------------------------

    def _join(self, other: KeyedDataset, how: str) -> KeyedDataset:
        # Fresh names let a dataset join itself or a relative without ambiguity; strategy is left to Catalyst and AQE.
        left = self.df.select(F.col("key").alias("__lk"), F.col("value").alias("left"))
        right = other.df.select(F.col("key").alias("__rk"), F.col("value").alias("right"))
        joined = left.join(right, F.col("__lk") == F.col("__rk"), how)
        key = F.col("__lk") if how in ("inner", "left") else F.col("__rk") if how == "right" else F.coalesce("__lk", "__rk")
        return KeyedDataset(joined.select(key.alias("key"), F.struct("left", "right").alias("value")))

    def join(self, other: KeyedDataset) -> KeyedDataset:
        """Values are structs (left, right). Null keys match nothing."""
        return self._join(other, "inner")

    def left_join(self, other: KeyedDataset) -> KeyedDataset:
        return self._join(other, "left")

    def right_join(self, other: KeyedDataset) -> KeyedDataset:
        return self._join(other, "right")

    def full_join(self, other: KeyedDataset) -> KeyedDataset:
        return self._join(other, "full")

    # ---- sorts -------------------------------------------------------------------------

    def sort_by_key(self, ascending: bool = True, partitions: int | None = None, by: Callable[[Column], Column] = lambda k: k) -> KeyedDataset:
        """Total order; nulls first ascending, last descending. ``by`` extracts what is compared."""
        return self._sorted(by(F.col("key")), ascending, partitions)

    def sort_by_value(self, ascending: bool = True, partitions: int | None = None, by: Callable[[Column], Column] = lambda v: v) -> KeyedDataset:
        return self._sorted(by(F.col("value")), ascending, partitions)

    def _sorted(self, what: Column, ascending: bool, partitions: int | None) -> KeyedDataset:
        order = what.asc() if ascending else what.desc()
        if partitions is None:
            return KeyedDataset(self.df.orderBy(order))
        return KeyedDataset(self.df.repartitionByRange(partitions, order).sortWithinPartitions(order))

    def sort_by_key_python(self, compare: Callable[[Any, Any], int]) -> KeyedDataset:
        """An opaque three-way comparator. The only operator on RDDs: no built-in sort takes a comparator."""
        compare = frozen(compare)
        rdd = self.df.rdd.sortBy(lambda r: _Compared(r["key"], compare))
        return KeyedDataset(self.df.sparkSession.createDataFrame(rdd, self.df.schema))

    # ---- actions -----------------------------------------------------------------------

    def collect(self) -> list[tuple[Any, Any]]:
        return [(r["key"], r["value"]) for r in self.df.select("key", "value").collect()]

    def collect_map(self) -> dict[Any, Any]:
        """A dict of all pairs; a repeated key is an error."""
        out: dict[Any, Any] = {}
        for key, value in self.collect():
            if key in out:
                raise ValueError(f"duplicate key {key!r}")
            out[key] = value
        return out

    def foreach(self, fn: Callable[[Any, Any], None]) -> None:
        fn = frozen(fn)
        self.df.foreach(lambda r: fn(r["key"], r["value"]))


class _Compared:
    """Sorts by a comparator; a plain class, so that it can be pickled to executors."""

    def __init__(self, value: Any, compare: Callable[[Any, Any], int]) -> None:
        self.value, self.compare = value, compare

    def __lt__(self, other: _Compared) -> bool:
        return self.compare(self.value, other.value) < 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Compared) and self.compare(self.value, other.value) == 0
