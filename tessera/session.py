"""Entry point: a context around one SparkSession, and the data sources that start a pipeline."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import infer_type, to_type
from tessera.operators.dataset import Dataset
from tessera.operators.keyed import KeyedDataset
from tessera.sources.custom import SplitSource, read_split_source
from tessera.workers import share_package

#: Settings every context starts from; all can be overridden with ``conf``.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


class ContextBuilder:
    """``Context.builder().local(4).conf("k", "v").get_or_create()``."""

    def __init__(self) -> None:
        self._master: str | None = None
        self._conf: dict[str, str] = dict(DEFAULTS)
        self._name = "tessera"

    def local(self, threads: int = 0) -> ContextBuilder:
        """Driver and executors share one JVM; 0 threads means one per core."""
        self._master = f"local[{threads or '*'}]"
        return self

    def local_cluster(self, cores: int, executors: int, memory_mb: int = 1024) -> ContextBuilder:
        """Separate executor JVMs on this machine, which exercises the network shuffle."""
        self._master = f"local-cluster[{executors},{cores},{memory_mb}]"
        self._conf["spark.executor.memory"] = f"{memory_mb}m"
        return self

    def master(self, url: str) -> ContextBuilder:
        self._master = url
        return self

    def app_name(self, name: str) -> ContextBuilder:
        self._name = name
        return self

    def conf(self, key: str, value: Any) -> ContextBuilder:
        self._conf[key] = str(value)
        return self

    def get_or_create(self) -> Context:
        builder = SparkSession.builder.appName(self._name)
        if self._master and SparkSession.getActiveSession() is None:
            builder = builder.master(self._master)
        for key, value in self._conf.items():
            builder = builder.config(key, value)
        return Context(builder.getOrCreate())


class Context:
    """Creates datasets. One Spark application backs all contexts of a process."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        share_package(spark)

    @staticmethod
    def builder() -> ContextBuilder:
        return ContextBuilder()

    # ---- in-memory sources -------------------------------------------------------------

    def make_dataset(self, rows: Iterable[Any], parallelism: int | None = None, dtype: str | T.DataType | None = None) -> Dataset:
        """Literal values as the column ``value``; the type is inferred from the values unless given."""
        rows = list(rows)
        kind = to_type(dtype) if dtype is not None else infer_type(rows)
        frame = self.spark.createDataFrame([(x,) for x in rows], T.StructType([T.StructField("value", kind)]))
        return Dataset(self._spread(frame, parallelism))

    def make_kv(self, rows: Sequence[tuple[Any, Any]], parallelism: int | None = None, key_type: str | T.DataType | None = None, value_type: str | T.DataType | None = None) -> KeyedDataset:
        """Literal pairs as the columns ``key`` and ``value``."""
        rows = list(rows)
        key = to_type(key_type) if key_type is not None else infer_type([k for k, _ in rows])
        value = to_type(value_type) if value_type is not None else infer_type([v for _, v in rows])
        schema = T.StructType([T.StructField("key", key), T.StructField("value", value)])
        return KeyedDataset(self._spread(self.spark.createDataFrame(rows, schema), parallelism))

    def empty(self, schema: str = "value string") -> Dataset:
        return Dataset(self.spark.createDataFrame([], schema))

    @staticmethod
    def _spread(frame: DataFrame, parallelism: int | None) -> DataFrame:
        return frame if parallelism is None else frame.repartition(parallelism)

    # ---- external sources --------------------------------------------------------------

    def text_file(self, path: str, parallelism: int | None = None) -> Dataset:
        """One row per line of a file or of the files directly in a folder, on any file system Spark reads.

        Large files are split; empty files give no rows; a missing path fails here, not at the action.
        """
        frame = self.spark.read.text(path)
        return Dataset(frame if parallelism is None else frame.coalesce(parallelism))

    def adjacency_file(self, path: str) -> KeyedDataset:
        """Graph text: line number (from 0) is the node, the line holds its targets; blank lines have no node row."""
        lines = self.text_file(path).zip_with_index().df
        targets = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long"))
        return KeyedDataset(lines.filter(F.trim("value") != "").select(F.col("index").alias("key"), targets.alias("value")))

    def read_table(self, sf_dir: str, name: str) -> Dataset:
        return Dataset(self.spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))

    def from_frame(self, frame: DataFrame) -> Dataset:
        return Dataset(frame)

    def from_source(self, source: SplitSource) -> Dataset:
        """A user-written connector: see :class:`tessera.sources.custom.SplitSource`."""
        return Dataset(read_split_source(self.spark, source))

    def run_job(self, dataset: Dataset, fn: Any) -> list[Any]:
        """Applies ``fn(iterator of rows)`` to every partition and returns one result per partition, in order."""
        return dataset.run_job(fn)

    def stop(self) -> None:
        self.spark.stop()
