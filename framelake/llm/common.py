"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches are bounded in rows and bytes because a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. Where it is unset, one of our own if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: paths made in each open scratch block, the innermost last
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives executors. At the end of the scratch block it
    goes; a table to be kept belongs to the block around that one, and stays where there is none."""
    path = f"{shared_dir(df.sparkSession)}/framelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if blocks := _scratch.get()[: -1 if keep else None]:
        blocks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that written() made."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with keep=True."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, made)


def release() -> None:
    """Gives memory that isn't used any more back to the machine; workers live on and run other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or an iterator of a UDF that releases memory at the end of its task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 500) -> DataFrame:
    """left join right on key, where one key may hold a large part of left and right has one row for each key.

    Keys with at least 1/share of left's rows number at most `share`, so their rows of right are broadcast;
    all other keys are joined by a shuffle. left should be a written table, as it is read three times."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    hot = counts.filter(F.col("_n") >= max(1000, total // share)).select(key).filter(F.col(key).isNotNull())
    hot = written(hot)
    some = F.broadcast(hot.join(right, key, "left" if how == "left" else "inner"))
    cold = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(some, key, "inner"))


def maybe_in(keys: DataFrame, key: str, bits: int = 1 << 24) -> Callable[[Column], Column]:
    """A test that holds for every value of keys[key] and for few others: a bit filter of fixed size, so that rows that
    can't join are dropped before a shuffle. Its words are or-ed by an aggregation; at most bits / 32 reach the driver."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(at(F.col(key)).alias("at")).groupBy(F.expr("at div 32 AS w")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 32 AS INT))) AS v"))
    got = words.toPandas()
    filled = np.zeros(bits // 32, dtype=np.uint32)
    filled[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def inside(at: pd.Series) -> pd.Series:
        n = at.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[n // 32] >> (n % 32).astype(np.uint32)) & 1 == 1)

    return lambda c: inside(at(c))


def joined_rows(same: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix of links the smallest row reachable from each row."""
    label = np.arange(len(same))
    while True:
        new = np.minimum(label, np.where(same, label[None, :], len(same)).min(1)) if len(same) else label
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, in parts of bounded size, as stars around each part's smallest nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def give() -> pa.RecordBatch:
        stars = [(x, find(x)) for x in list(root)]
        stars = [e for e in stars if e[0] != e[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in stars], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 500_000:
            yield give()
    yield give()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node reachable.

    Each task first contracts its own edges to stars. Then come alternating large-star and small-star rounds; each is a
    pre-aggregated minimum for each node and a join, so no neighbourhood is ever gathered, and its result is written
    before the next one. They end when no node has two parents or is a parent and a child."""
    e = written(edges.select("a", "b").mapInArrow(_stars, "a long, b long").distinct())
    while True:
        nodes = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not nodes.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").limit(1).count():
            break
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        e = written(small.select("e.a", "e.b").filter("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
