"""Reading test tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is
    used, which is only right while driver and executors share one machine, so any other master is refused;
    it is removed when the process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quillrank-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    As ``checkpoint``, but compressed by column, read again only in the columns that are asked for, and with the
    size it really has: a checkpoint keeps the size its plan was guessed at, which can make a join broadcast it.
    """
    path = f"{shared_folder(df.sparkSession)}/kept/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its bytes: at least one a core, more where shuffles have more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package; clusters get it by --py-files or PYTHONPATH."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in (known + os.pathsep + os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
