"""Tables that grow by counted batches: a batch is seen only once its rows are known to have landed in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from framelake.sources.scratch import delete

LOG = "batch long, seq long, expected long, landed long, folder string"


class CountError(ValueError):
    """A batch has other rows than it should."""


class CommittedTable:
    """A folder of batches and a log. A batch is written to a folder of its own and counted there; the log then gets a row
    with both counts. Readers see the last logged folder of each batch, so a write that fails or is refused leaves the
    table as it was, and a batch that is written again takes the place of its former self."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def log(self) -> DataFrame:
        """The current row of each batch."""
        if not self._there(f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        w = Window.partitionBy("batch").orderBy(F.desc("seq"))
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    def _next(self) -> int:
        if not self._there(f"{self.path}/log"):
            return 0
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").agg(F.max("seq")).first()[0] + 1

    def _logged(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def append(self, rows: DataFrame, batch: int, expected: int | None = None) -> int:
        """Writes a batch. expected: how many rows it should have; by default as many as were read while it was written."""
        seq = self._next()
        folder = f"data/{seq}-{batch}"
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        landed = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").count()
        wanted = seen.get["n"] if expected is None else expected
        if landed != wanted:
            delete(self.spark, f"{self.path}/{folder}")
            raise CountError(f"batch {batch}: {wanted} rows expected, {landed} landed")
        self._logged([(batch, seq, wanted, landed, folder)])
        return landed

    def read(self) -> DataFrame:
        """All rows of committed batches with their batch."""
        current = self.log().select("folder", "batch").collect()  # a row for each batch
        if not current:
            raise ValueError(f"nothing is committed in {self.path}")
        df = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{r['folder']}" for r in current])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+-\d+)/[^/]*$", 1)
        return df.withColumn("batch", F.split(name, "-")[1].cast("long"))

    def with_column(self, name: str, value: Column, if_there: str = "error") -> bool:
        """Adds a column to all committed batches; False if it was there and is kept. if_there: 'skip', 'overwrite' or
        'error'. New folders replace the old ones in one log write, after their rows were counted."""
        if if_there not in ("skip", "overwrite", "error"):
            raise ValueError(f"if_there is {if_there!r}")
        there = name in self.read().columns
        if there and if_there == "error":
            raise ValueError(f"there is a column {name!r}")
        if there and if_there == "skip":
            return False
        seq, new = self._next(), []
        for r in self.log().orderBy("batch").collect():
            folder = f"data/{seq}-{r['batch']}"
            df = self.spark.read.parquet(f"{self.path}/{r['folder']}").withColumn(name, value)
            df.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            landed = self.spark.read.parquet(f"{self.path}/{folder}").count()
            if landed != r["landed"]:
                raise CountError(f"batch {r['batch']}: {r['landed']} rows expected, {landed} landed")
            new.append((r["batch"], seq, r["expected"], landed, folder))
        self._logged(new)
        return True

    def vacuum(self) -> int:
        """Deletes folders that no reader sees any more; how many."""
        if not self._there(f"{self.path}/log"):
            return 0
        keep = {r["folder"] for r in self.log().select("folder").collect()}
        old = {r["folder"] for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log").select("folder").distinct().collect()} - keep
        gone = [f"{self.path}/{folder}" for folder in sorted(old) if self._there(f"{self.path}/{folder}")]
        for path in gone:
            delete(self.spark, path)
        return len(gone)

    def sink(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A stream into the table: a batch that runs again after a failure takes the place of its former self."""

        def write(batch: DataFrame, number: int) -> None:
            self.append(batch, number)

        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
