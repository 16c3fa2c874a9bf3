"""Durable intermediate results in the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="syncohort-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/syncohort/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, name: str = "step") -> DataFrame:
    """Write `frame` as a table in the shared folder and go on from that table.

    Used where one intermediate result feeds several later stages: it is computed
    once, all stages see the same rows even if executors are lost in between, and
    each stage reads only the columns it needs.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to `path` to its end."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def join_constants(
    frame: DataFrame, constants: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Give the rows of `frame` the constants of their group, without moving them if possible.

    `constants` is written first. Spark then knows its size: below its own limit it goes
    to the rows, and only beyond it the rows go to their group, whose skew Spark splits.
    No keys mean one row of constants for all.
    """
    small, keys = cut(constants, "constants"), list(keys)
    if keys:
        return frame.join(small, keys, how)
    one = F.lit(0).alias("_one")
    return frame.select("*", one).join(small.select("*", one), "_one", how).drop("_one")
