"""The routing table of a stream of events.

Each micro-batch joins the log that is kept, the log is compacted to what any later fold needs, and its fold is the
table. The kept log is a Parquet folder for each batch, so a batch that runs again after a failure starts from the log
before it and writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prefixlake.operators.rib import compact, fold


def _log(spark, folder: str, schema, before: int) -> DataFrame | None:
    """The newest log of a batch under ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    old = [k for k in done if k < before]
    return spark.read.schema(schema).parquet(f"{folder}/batch={old[-1]}") if old else None


def fold_stream(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the fold of a stream of events; ``folder`` is shared by driver and executors, as is ``checkpoint``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = _log(spark, folder, batch.schema, number)
        compact(batch if kept is None else kept.unionByName(batch)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def table(spark, folder: str, schema, retain: bool = True) -> DataFrame:
    """The routing table after the last batch."""
    kept = _log(spark, folder, schema, 1 << 62)
    return fold(kept if kept is not None else spark.createDataFrame([], schema), retain)
