"""User-written connectors on Spark's Python data source API: splits are planned once and read in parallel."""

from __future__ import annotations

import base64
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Split(InputPartition):
    """A part of a source that one task reads; carries whatever the source needs to find it."""

    def __init__(self, value: Any) -> None:
        self.value = value


class SplitSource(ABC):
    """Implement ``schema``, ``splits`` and ``read``; instances travel to the executors by pickling."""

    @abstractmethod
    def schema(self) -> str:
        """Spark DDL of the rows."""

    @abstractmethod
    def splits(self) -> Sequence[Any]:
        """Descriptors of independent parts, planned on the driver."""

    @abstractmethod
    def read(self, split: Any) -> Iterator[tuple]:
        """The rows of one part, read on an executor."""

    def close(self) -> None:
        """Called after each part, also when reading it failed."""


class _Reader(DataSourceReader):
    def __init__(self, source: SplitSource) -> None:
        self.source = source

    def partitions(self) -> Sequence[Split]:
        return [Split(x) for x in self.source.splits()]

    def read(self, partition: Split) -> Iterator[tuple]:
        try:
            yield from self.source.read(partition.value)
        finally:
            self.source.close()


class _SplitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_splits"

    @property
    def _source(self) -> SplitSource:
        return cloudpickle.loads(base64.b64decode(self.options["source"]))

    def schema(self) -> str:
        return self._source.schema()

    def reader(self, schema: Any) -> _Reader:
        return _Reader(self._source)


def read_split_source(spark: SparkSession, source: SplitSource) -> DataFrame:
    """A source without splits gives an empty frame of its schema."""
    if not source.splits():
        return spark.createDataFrame([], source.schema())
    spark.dataSource.register(_SplitDataSource)
    return spark.read.format("tessera_splits").option("source", base64.b64encode(cloudpickle.dumps(source)).decode()).load()
