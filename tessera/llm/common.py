"""What the training-data operators share: text access, batch limits, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checkpoints import ensure_checkpoint_dir
from tessera.workers import share_package

#: Rows that one Arrow batch holds, so that a batch of very long texts still fits in a Python worker.
BATCH_ROWS = 256
#: Rows and bytes up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python runs on the executors: the size of its batches, and where it finds this package."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns of any name do no harm and are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``row`` beside named columns, so that none of theirs clashes with these."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def arrow_column(fn: Callable[[pa.Array], pa.Array], kind: str | T.DataType, *inputs: Column) -> Column:
    """A vectorised function over Arrow arrays as a Column."""

    if len(inputs) == 1:

        def run(x: pa.Array) -> pa.Array:
            return fn(x)

    else:

        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            return fn(x, y)

    return F.arrow_udf(run, kind)(*inputs)


#: Lets Spark delete the shuffle files of a query when it ends; otherwise they stay until the driver collects its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """For queries whose rows are written: nothing reads their shuffle files again."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them back: later uses don't compute them again."""
    ensure_checkpoint_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new plan, which knows of the setting


def materialized(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, but as compressed Parquet files in a folder of their own: for large tables.

    The folder stays until :func:`discarded` deletes it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialized` wrote, as soon as all that is computed from them is written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """Marks a table for broadcast if counting its rows shows that it is small enough. It should be written or cheap.

    ``width`` is the size in bytes of a row's column without a fixed size, such as an array; such a table must also stay
    within BROADCAST_BYTES. A table that is not small is joined by a shuffle.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if width is None else width).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= BROADCAST_ROWS and (seen["bytes"] or 0) <= BROADCAST_BYTES else df


__all__ = ["ascii_lower", "arrow_column", "bound_batches", "boxed", "checkpointed", "discarded", "ensure_checkpoint_dir", "keyed_text", "materialized", "quoted", "small"]
