"""Tables written between the steps of an operator: they cut the lineage, outlive executors and are deleted at the end."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder that all machines see, inside spark.checkpoint.dir. Where that is unset and all runs on this machine, one
    of our own is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/steps-{uuid.uuid4().hex}"


class Steps:
    """The tables of one operator."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table beside the steps, which stays."""
        path = f"{self.path}-result"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    own = Steps(spark)
    try:
        yield own
    finally:
        delete(spark, own.path)
