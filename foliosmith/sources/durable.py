"""Tables in the shared folder for checkpoints: written once and read again, so that lineage ends and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Where checkpoints go; sets a temporary folder only where nothing is set and the master is local, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def durable(frame: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again; ``compression`` is the session's if not named."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)
