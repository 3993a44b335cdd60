"""Datasets grouped by a key expression."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.aggregators import AggFunction, FoldFunction, merged, partial_states
from tessera.functions.exprs import named_reducer
from tessera.functions.types import to_type
from tessera.operators.dataset import Dataset, frozen, unwrap
from tessera.operators.keyed import KeyedDataset


class GroupedDataset:
    def __init__(self, df: DataFrame, key: Column) -> None:
        self.df = df
        self.key = key
        self.keyed: DataFrame | None = None

    def _keyed(self) -> DataFrame:
        if self.keyed is not None:
            return self.keyed
        return self.df.select(self.key.alias("__key"), *[F.col(f"`{c}`") for c in self.df.columns])

    def agg(self, **columns: Column) -> Dataset:
        """Named aggregate expressions beside the key; combined before the shuffle."""
        return Dataset(self.df.groupBy(self.key.alias("key")).agg(*[c.alias(k) for k, c in columns.items()]))

    def reduce_groups(self, reducer: str | Callable[[Column], Column]) -> KeyedDataset:
        """(key, reduced row). The reducer gets the row as a struct, or ``value`` if that is the only column."""
        row = F.col("value") if self.df.columns == ["value"] else F.struct(*[F.col(f"`{c}`") for c in self.df.columns])
        return KeyedDataset(self.df.groupBy(self.key.alias("key")).agg(named_reducer(reducer)(row).alias("value")))

    def reduce_groups_python(self, fn: Callable[[Any, Any], Any], schema: str) -> KeyedDataset:
        return self.aggregate_python(FoldFunction(frozen(fn)), schema)

    def aggregate_python(self, agg: AggFunction, schema: str) -> KeyedDataset:
        """A user aggregate with map-side partial states, so that a hot key reaches its task as one state per map task."""
        names = self.df.columns
        frame = self._keyed()
        key = frame.schema["__key"]
        mid = T.StructType([T.StructField("key", key.dataType), T.StructField("state", T.BinaryType())])
        out = T.StructType([T.StructField("key", key.dataType), T.StructField("value", to_type(schema))])
        mid_arrow, out_arrow = to_arrow_schema(mid), to_arrow_schema(out)

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            renamed = (b.rename_columns(["key", *b.schema.names[1:]]) for b in batches)
            value_of = lambda r: unwrap(Row(**{n: r[n] for n in names}))
            yield from partial_states(agg, ["key"], value_of, renamed, mid_arrow)

        def finish(table: pa.Table) -> pa.Table:
            value = merged(agg, table.column("state").to_pylist())
            return pa.table([pa.array([table.column("key")[0].as_py()], out_arrow[0].type), pa.array([value], out_arrow[1].type)], schema=out_arrow)

        if "key" in names:
            renamed = [n if n != "key" else "__value_key" for n in names]
            frame, names = frame.toDF("__key", *renamed), renamed
        return KeyedDataset(frame.mapInArrow(combine, mid).groupBy("key").applyInArrow(finish, out))

    def map_groups(self, fn: Callable[[Column], Any]) -> Dataset:
        """One output per group as an aggregate expression over the rows; the key is not emitted."""
        row = F.col("value") if self.df.columns == ["value"] else F.struct(*[F.col(f"`{c}`") for c in self.df.columns])
        return Dataset(self.df.groupBy(self.key.alias("__key")).agg(fn(row).alias("value")).select("value"))

    def map_groups_python(self, fn: Callable[[Any, Iterator[Any]], Any], schema: str) -> Dataset:
        """Opaque function of (key, iterator of rows) streamed over key-sorted partitions; the key is not emitted."""

        def each(pairs: Iterator[tuple[Any, Any]], _fn: Callable = frozen(fn)) -> Iterator[Any]:
            for key, rows in itertools.groupby(pairs, key=lambda kv: kv[0]):
                yield _fn(key, (r for _, r in rows))

        return self.map_partition_python(each, schema)

    def map_partition_python(self, fn: Callable[[Iterator[tuple[Any, Any]]], Iterator[Any]], schema: str) -> Dataset:
        """A partition's (key, row) pairs, clustered and sorted by key. Groups stream: none has to fit in memory."""
        fn = frozen(fn)
        clustered = self._keyed().repartition("__key").sortWithinPartitions("__key")
        pairs = lambda rows: ((r[0], unwrap(Row(**dict(zip(r.__fields__[1:], r[1:], strict=True))))) for r in rows)
        return Dataset(clustered).map_partition_python(lambda rows: fn(pairs(rows)), schema)
