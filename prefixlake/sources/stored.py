"""Intermediate tables as Parquet in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset and Spark runs in one process (tests), a temporary folder is made and kept in the session's
    settings; on a cluster an unset folder is an error, since a machine-local one would lose rows.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="prefixlake-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives Catalyst the true size, so that joins broadcast a side only
    below spark.sql.autoBroadcastJoinThreshold and shuffle it beyond. What is used several times is made once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
