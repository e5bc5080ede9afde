"""Lineage cuts for iterative plans: reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session setting by which Spark removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Session setting by which Spark splits generated methods beyond a size; HotSpot compiles none beyond 8,000 bytes, and runs them step by step.
METHODS = "spark.sql.codegen.hugeMethodLimit"


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


@contextmanager
def _with(spark: SparkSession, **settings: str) -> Iterator[None]:
    names = {"cleanup": CLEANUP, "methods": METHODS}
    before = {names[k]: spark.conf.get(names[k], None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(names[k], value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  A local master without one gets a
    temporary folder, as in tests; a cluster without one is an error, since a machine-local
    folder would be lost with its executor.  What has been stored needs its shuffle files no
    longer, so they go with the execution rather than when the driver collects its garbage.
    """
    _shared_folder(df.sparkSession)
    with _with(df.sparkSession, cleanup="true"):
        return df.select("*").checkpoint(eager=True)  # a plan made here, as a plan keeps the setting it was made under


def stored(df: DataFrame, split: bool = False) -> DataFrame:
    """The same cut as Parquet files, for wide rows of which each fills a few fields only.

    A checkpoint holds such rows at their full width; a column of nulls takes no room here.
    ``split``: plans with large expressions run in methods small enough to be compiled.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with _with(spark, cleanup="true", **({"methods": "8000"} if split else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
