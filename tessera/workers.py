"""What all Python workers must agree on: where this package is, and how strings are hashed."""

import os

from pyspark.sql import SparkSession

_TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Puts the folder of this package on the workers' import path.

    Workers on this machine then find it wherever the driver was started; on a cluster the package is installed or sent
    with ``--py-files`` as usual. String hashes are the same in all workers, which Spark sees to unless it is told not to.
    """
    environment = spark.sparkContext.environment
    if environment.get("PYTHONHASHSEED", "random") == "random":
        environment["PYTHONHASHSEED"] = "0"
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _TOP not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_TOP, *paths])
