"""The ledger fold as a stream: each micro-batch is appended to a log, and the runs that it touches are folded anew.

The fold itself is set-based (``operators.ledger_fold``), so a touched run is folded by many tasks.
A micro-batch writes its own events and one row for each run it touches, never a run's history; what is
written is named by the batch, so one that comes again replaces what it wrote before.  Runs are
dealt into buckets by hash, and only the touched buckets' events are read.  Late results are told by
sequence, so no watermark is involved; events may come in any order and batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.ledger_fold import EVENT, fold

BUCKETS = 256

__all__ = ["BUCKETS", "EVENT", "fold", "fold_stream", "states"]


def fold_stream(events: DataFrame, folder: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer of the stream ``events`` (EVENT) into ``folder``: set its trigger and checkpoint, and start it."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
        log, now = f"{folder}/events", f"{folder}/events/batch={number}"
        told.write.mode("overwrite").partitionBy("bucket").parquet(now)
        mine = spark.read.schema(f"{EVENT}, bucket int").option("basePath", now).parquet(now)
        touched = mine.select("run_id", "bucket").distinct()
        parts = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        if not parts:
            return
        before = spark.read.schema(f"{EVENT}, batch long, bucket int").option("basePath", log).parquet(log).filter(F.col("bucket").isin(parts) & (F.col("batch") <= number))
        same = F.col("e.run_id").eqNullSafe(F.col("t.run_id"))
        runs = before.alias("e").join(touched.select("run_id").alias("t"), same, "left_semi").select("e.run_id", "e.seq", "e.type", "e.payload")
        fold(runs).write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    return events.writeStream.foreachBatch(step)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each run that the stream has folded."""
    every = spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states")
    names = [c for c in every.columns if c != "batch"]
    return every.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in names if c != "run_id"]), "batch").alias("s")).select("run_id", "s.*")
