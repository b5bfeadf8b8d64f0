"""The memo as a table bucketed and sorted by its key, in a folder: joins and groups on the key read it without a shuffle.

The folder is a table of the session's catalog while it is in use, under a name made of its path, so nothing but the folder has to last.  Each
append adds at most one file a bucket; ``compact`` leaves one of each, with the newest entry of each key.  Files and entries that can't be read are misses,
never an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .files import MEMO

BUCKETS = 64
_COLUMNS = f"{MEMO}, buckets int"


def _named(path: str, buckets: int) -> str:
    return f"memo_{hashlib.sha256(f'{path}|{buckets}'.encode()).hexdigest()[:24]}"


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    name, at = _named(path, buckets), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet OPTIONS (ignoreCorruptFiles 'true', ignoreMissingFiles 'true') CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{at}'")
    spark.catalog.refreshTable(name)
    return name


def read_memo(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The entries of a memo, none where there is no folder yet; a folder of another number of buckets is an error."""
    rows = spark.table(_table(spark, path, buckets))
    other = rows.filter(F.col("buckets") != buckets).limit(1).collect()
    if other:
        raise ValueError(f"the memo in {path} has {other[0]['buckets']} buckets, not {buckets}")
    return rows.drop("buckets")


def append_memo(entries: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds entries, each bucket of them by one task."""
    _write(entries.repartition(buckets, "key"), path, buckets)


def _write(entries: DataFrame, path: str, buckets: int) -> None:
    cut = F.col("truncated") if "truncated" in entries.columns else F.lit(False).alias("truncated")
    rows = entries.select("key", "value_schema", "text", "written_at", cut, F.lit(buckets).alias("buckets"))
    rows.write.format("parquet").bucketBy(buckets, "key").sortBy("key").mode("append").saveAsTable(_table(entries.sparkSession, path, buckets))


def compact(spark: SparkSession, path: str, target: str, buckets: int = BUCKETS) -> None:
    """The newest entry of each key and schema, in a new folder ``target``; whoever reads ``path`` is not disturbed.  No row is shuffled."""
    last = Window.partitionBy("key", "value_schema").orderBy(F.col("written_at").desc(), F.col("text").desc())
    sound = read_memo(spark, path, buckets).filter("key is not null and text is not null")
    _write(sound.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1").drop("__nth"), target, buckets)
