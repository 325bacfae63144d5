"""Tables in the folder that driver and executors share, named by the cluster in spark.checkpoint.dir.

Where that is unset, as in tests, a folder below the warehouse is used. A table that only later steps of one
call read is discarded by that call; those that a result is read from are left, and the folder's owner clears it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return path.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and it survives the loss of executors."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what saved wrote for these; nothing may be read from them afterwards."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.get("_saved_at")
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
