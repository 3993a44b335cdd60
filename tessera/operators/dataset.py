"""Un-keyed datasets: projections, filters, set operations, partitioning, caching and actions.

A dataset wraps a DataFrame. Operators that take a function hand it Columns, so Catalyst sees the whole plan: a dataset
whose only column is ``value`` passes that column, any other passes a :class:`Fields` view. The ``*_python`` variants
run opaque Python over Arrow batches.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.checkpoints import ensure_checkpoint_dir
from tessera.functions.exprs import named_reducer
from tessera.functions.types import to_type

if TYPE_CHECKING:
    from tessera.operators.grouped import GroupedDataset
    from tessera.operators.keyed import KeyedDataset

CACHE_MODES = {"MEM_ONLY": StorageLevel.MEMORY_ONLY, "MEM_DISK": StorageLevel.MEMORY_AND_DISK, "DISK_ONLY": StorageLevel.DISK_ONLY}
_OFFSET_BITS = 33


class Fields:
    """Column access by name for functions over rows with several columns."""

    def __init__(self, frame: DataFrame) -> None:
        self._names = frame.columns

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return F.col(f"`{name}`")

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise KeyError(name)
        return F.col(f"`{name}`")


def frozen(fn: Callable) -> Callable:
    """A deep copy, so that captured state changed after the definition is not seen by the job."""
    return cloudpickle.loads(cloudpickle.dumps(fn))


def unwrap(row: Row) -> Any:
    return row[0] if len(row) == 1 else row


class Dataset:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # ---- helpers -----------------------------------------------------------------------

    def _like(self, df: DataFrame) -> Dataset:
        return type(self)(df)

    @property
    def row(self) -> Any:
        return F.col("value") if self.df.columns == ["value"] else Fields(self.df)

    def _struct(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.df.columns])

    @staticmethod
    def _projection(out: Any) -> list[Column]:
        if isinstance(out, dict):
            return [c.alias(k) for k, c in out.items()]
        if isinstance(out, (list, tuple)):
            return list(out)
        return [out.alias("value")]

    # ---- narrow transforms -------------------------------------------------------------

    def map(self, fn: Callable[[Any], Any]) -> Dataset:
        """``fn`` returns a Column (named ``value``), a dict of names to Columns, or a list of aliased Columns."""
        return Dataset(self.df.select(*self._projection(fn(self.row))))

    def flat_map(self, fn: Callable[[Any], Column]) -> Dataset:
        """``fn`` returns an array Column; each element becomes a row. Null and empty arrays give none."""
        return Dataset(self.df.select(F.explode(fn(self.row)).alias("value")))

    def filter(self, fn: Callable[[Any], Column]) -> Dataset:
        return self._like(self.df.filter(fn(self.row)))

    def map_python(self, fn: Callable[[Any], Any], schema: str) -> Dataset:
        """Opaque 1:1 function over rows (a bare value if there is one column)."""
        return self.map_partition_python(lambda rows, _fn=frozen(fn): (_fn(r) for r in rows), schema)

    def flat_map_python(self, fn: Callable[[Any], Iterable[Any]], schema: str) -> Dataset:
        return self.map_partition_python(lambda rows, _fn=frozen(fn): itertools.chain.from_iterable(map(_fn, rows)), schema)

    def filter_python(self, fn: Callable[[Any], bool]) -> Dataset:
        kept = self.map_partition_python(lambda rows, _fn=frozen(fn): (r for r in rows if _fn(r)), self.df.schema)
        return self._like(kept.df)

    def map_partition_python(self, fn: Callable[[Iterator[Any]], Iterator[Any]], schema: str | T.StructType, batch_rows: int = 10_000) -> Dataset:
        """Opaque iterator function per partition; returning None is an error."""
        return self.map_partition_with_id_python(lambda _id, rows, _fn=frozen(fn): _fn(rows), schema, batch_rows)

    def map_partition_with_id_python(self, fn: Callable[[int, Iterator[Any]], Iterator[Any]], schema: str | T.StructType, batch_rows: int = 10_000) -> Dataset:
        fn = frozen(fn)
        spark_schema = to_type(schema)
        if not isinstance(spark_schema, T.StructType):
            spark_schema = T.StructType([T.StructField("value", spark_schema)])
        arrow, single = to_arrow_schema(spark_schema), len(spark_schema) == 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = (unwrap(Row(**r)) for b in batches for r in b.to_pylist())
            out = fn(TaskContext.get().partitionId(), rows)
            if out is None:
                raise ValueError("a partition function returned None")
            out = iter(out)
            while chunk := list(itertools.islice(out, batch_rows)):
                columns = [[r] if single and not isinstance(r, tuple) else list(r) for r in chunk]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in columns], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        return Dataset(self.df.mapInArrow(run, spark_schema))

    def key_by(self, key: Callable[[Any], Column], value: Callable[[Any], Any] | None = None) -> KeyedDataset:
        """Pairs (key, value); without ``value`` the whole row is the value."""
        from tessera.operators.keyed import KeyedDataset

        row = self.row
        if value is not None:
            out = value(row)
        elif isinstance(row, Column):
            out = row
        else:
            out = self._struct()
        return KeyedDataset(self.df.select(key(row).alias("key"), out.alias("value")))

    def to_keyed(self) -> KeyedDataset:
        """Lifts a two-column dataset at no cost."""
        from tessera.operators.keyed import KeyedDataset

        if isinstance(self, KeyedDataset):
            return self
        if len(self.df.columns) != 2:
            raise ValueError(f"a pair dataset has two columns, not {self.df.columns}")
        return KeyedDataset(self.df.toDF("key", "value"))

    def encoder(self, spec: str | T.DataType) -> Dataset:
        """Casts the single column to an encoder's type."""
        if self.df.columns != ["value"]:
            raise ValueError("encoder() applies to a dataset with the one column 'value'")
        return Dataset(self.df.select(F.col("value").cast(to_type(spec)).alias("value")))

    def _numbered(self) -> DataFrame:
        return self.df.withColumn("__at", F.monotonically_increasing_id())

    def zip_with_index(self, order_by: Iterable[Column | str] | None = None, name: str = "index") -> Dataset:
        """Adds a contiguous 0-based index, in partition order or by a total order.

        Rows get partition-local offsets and one small job counts rows per partition; no partition ever holds all rows.
        The numbered rows are checkpointed, since the counts hold only for the partitions that were counted.
        """
        ensure_checkpoint_dir(self.df.sparkSession)
        base = self.df.orderBy(*order_by) if order_by is not None else self.df
        at = F.monotonically_increasing_id()
        part = F.shiftright("__at", _OFFSET_BITS)
        offset = F.col("__at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
        numbered = base.withColumn("__at", at).checkpoint()
        counts = sorted((r[0], r[1]) for r in numbered.groupBy(part.alias("p")).count().collect())
        starts = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0), strict=False))
        if not starts:
            return Dataset(base.withColumn(name, F.lit(0).cast("long")))
        if len(starts) > STARTS_IN_PLAN:
            first = base.sparkSession.createDataFrame([(p, n) for p, n in starts.items() if n >= 0], "__part long, __start long")
            met = numbered.join(F.broadcast(first), part == F.col("__part"))  # a row for each partition
            return Dataset(met.withColumn(name, F.col("__start") + offset).drop("__at", "__part", "__start"))
        # One row per partition; the array is indexed by partition id.
        table = F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts) + 1)])
        return Dataset(numbered.withColumn(name, F.get(table, part.cast("int")) + offset).drop("__at"))

    def partition_limit(self, n: int) -> Dataset:
        """The first ``n`` rows of each partition."""
        offset = F.col("__at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
        return self._like(self._numbered().filter(offset < n).drop("__at"))

    def limit(self, n: int) -> Dataset:
        return self._like(self.df.limit(n))

    # ---- partitioning ------------------------------------------------------------------

    def repartition(self, n: int) -> Dataset:
        """Hash by the whole row, sorted by the row inside each partition; duplicates stay."""
        cols = [F.col(f"`{c}`") for c in self.df.columns]
        return self._like(self.df.repartition(n, *cols).sortWithinPartitions(*cols))

    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def partitioner(self) -> str:
        """Spark's description of how the rows are dealt out."""
        return self.df._jdf.queryExecution().executedPlan().outputPartitioning().toString()

    # ---- set operations ----------------------------------------------------------------

    def union_all(self, other: Dataset) -> Dataset:
        return self._like(self.df.unionAll(other.df))

    def union(self, other: Dataset, partitions: int | None = None) -> Dataset:
        """Set union: duplicates within and across the inputs go."""
        return self.union_all(other).distinct(partitions)

    def distinct(self, partitions: int | None = None) -> Dataset:
        df = self.df if partitions is None else self.df.repartition(partitions, *[F.col(f"`{c}`") for c in self.df.columns])
        return self._like(df.distinct())

    # ---- grouping ----------------------------------------------------------------------

    def group_by(self, key: Callable[[Any], Column]) -> GroupedDataset:
        from tessera.operators.grouped import GroupedDataset

        return GroupedDataset(self.df, key(self.row))

    # ---- caching -----------------------------------------------------------------------

    def cache(self, mode: str = "MEM_ONLY") -> Dataset:
        if mode not in CACHE_MODES:
            raise ValueError(f"unknown cache mode {mode!r}; known: {', '.join(CACHE_MODES)}")
        return self._like(self.df.persist(CACHE_MODES[mode]))

    def uncache(self, blocking: bool = True) -> Dataset:
        self.df.unpersist(blocking)
        return self

    # ---- actions -----------------------------------------------------------------------

    def collect(self) -> list[Any]:
        return [unwrap(r) for r in self.df.collect()]

    def count(self) -> int:
        return self.df.count()

    def reduce(self, reducer: str | Callable[[Column], Column]) -> Any | None:
        """Folds the column ``value`` with a named reducer or an aggregate expression; None if there are no rows."""
        out = self.df.agg(F.count(F.lit(1)).alias("n"), named_reducer(reducer)(F.col("value")).alias("out")).first()
        return out["out"] if out["n"] else None

    def reduce_python(self, fn: Callable[[Any, Any], Any]) -> Any | None:
        """Opaque fold: one partial result per partition is folded on the driver in partition order."""
        import functools

        fn = frozen(fn)
        parts = self.run_job(lambda rows: [functools.reduce(fn, rows, first)] if (first := next(rows, _END)) is not _END else [])
        found = list(itertools.chain.from_iterable(parts))
        return functools.reduce(fn, found) if found else None

    def foreach(self, fn: Callable[[Any], None]) -> None:
        fn = frozen(fn)
        self.df.foreach(lambda r: fn(unwrap(r)))

    def foreach_partition(self, fn: Callable[[Iterator[Any]], None]) -> None:
        fn = frozen(fn)
        self.df.foreachPartition(lambda rows: fn(map(unwrap, rows)))

    def print(self, n: int = 10) -> None:
        for row in self.df.take(n):
            print(unwrap(row))

    def run_job(self, fn: Callable[[Iterator[Any]], Any]) -> list[Any]:
        """One result per partition, in partition order."""
        fn = frozen(fn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            out = fn(unwrap(Row(**r)) for b in batches for r in b.to_pylist())
            yield pa.RecordBatch.from_pydict({"p": [TaskContext.get().partitionId()], "out": [pickle.dumps(out)]})

        rows = self.df.mapInArrow(run, "p long, out binary").collect()
        return [pickle.loads(r["out"]) for r in sorted(rows, key=lambda r: r["p"])]

    def write(self, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Iterable[str] = ()) -> None:
        self.df.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)

    def explain(self) -> None:
        self.df.explain("formatted")


_END = object()
#: Partitions whose first numbers are written into the plan; those of more are joined.
STARTS_IN_PLAN = 10_000
