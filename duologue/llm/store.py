"""Stage tables in the folder that driver and executors share.

A stage that is read more than once is written there as Parquet and read again: that cuts
lineage, survives lost executors, and keeps costly Python stages from running twice.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of an execution that ran under this setting as soon as it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or ``setCheckpointDir``; a temporary one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("stage tables need a folder that driver and executors share: set spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="duologue-")
        atexit.register(_remove, spark, root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Stage tables of one operator call. ``drop`` removes those no later step reads; the rest go when Python exits.

    Results are lazy and read the last stage tables, so these cannot go with the call.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/duologue-{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with _setting(self.spark, CLEANUP, "true"):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.base}/{name}")
