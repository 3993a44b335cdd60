"""Where reliable checkpoints go."""

from pyspark.sql import SparkSession

DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a folder of this machine serves a master that runs in one process; on a cluster that is an error,
    since each node would write to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or DEFAULT_CHECKPOINT_DIR)
