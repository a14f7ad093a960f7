"""Bucketed tables by path: rows hashed on a key into a fixed number of files.

Two tables with the same number of buckets on the columns of a join, or one table grouped on
its key, need no exchange. The files lie under a path of the caller's choice; the session's catalog holds only the
description (schema, key, buckets), written again by every session that reads them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"chatlens_bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``df`` in one file for each bucket that holds rows, sorted by ``key``; replaces what is under ``path``."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(_name(path)))


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` left under ``path``."""
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({schema}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(_name(path))
