"""Operator 7, quality classifier by importance resampling.

Two bags of hashed words and word pairs are learned: of the target, labelled texts of good quality that aren't toxic, and of
the raw corpus, all texts whole. A document's log-weight is the sum over its n-grams of log p_target - log p_raw. Documents
are drawn without replacement by Gumbel top-k: each gets noise from a hash of its id and text, and the k largest sums of
log-weight and noise are selected; k is the share of target labels times the number of documents.

The target is learned from at most LABELS labelled ids, those with the smallest hashes; they are sent to the tasks. The raw
counts have BUCKETS entries. The k-th largest key is found by counting in bins, again inside the bin that holds it, so
nothing is sorted. Rows with equal keys (repeated rows) are selected together.

Null and empty texts have log-weight 0. Without a target text all log-weights are 0, and without labels all are selected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import scratch, written

BUCKETS, LABELS, SMOOTH = 1 << 16, 50_000, 1.0
MEMO, BINS, FEW = 300_000, 4096, 10_000


class Memo(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_memo = Memo()


def grams(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    words = text.split() if text else []
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def fit(docs: DataFrame, good: set[int]) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                sums[0] += n
                if doc in shared.value:
                    sums[1] += n
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    got = rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy(dtype=np.int64)  # a row for each bucket
    n = np.zeros((2, BUCKETS))
    n[:, got[:, 0]] = got[:, 1:].T
    if not n[1].any():
        return np.zeros(BUCKETS)
    p = np.log((n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * BUCKETS))
    return p[1] - p[0]


def log_weight(text: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([float(weights[grams(t)].sum()) for t in texts], dtype=float)

    return run(text)


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """Exact, for a written table: bins are counted, and counted again inside the one that holds the answer."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    while True:
        inside = df.filter(F.col(key).between(low, high))
        width = (high - low) / BINS
        if width <= 0:
            return low
        at = F.least(F.lit(BINS - 1), F.floor((F.col(key) - low) / width)).cast("int")
        found = inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()  # a row for each bin
        for r in sorted(found, reverse=True):
            if r["n"] >= k:
                break
            k -= r["n"]
        low, high = r["lo"], r["hi"]
        if r["n"] <= FEW:
            values = df.filter(F.col(key).between(low, high)).select(key).toPandas()[key].to_numpy()
            return float(np.sort(values)[::-1][k - 1])


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality, toxic): doc_id, log_weight, key, selected."""
    with scratch(docs.sparkSession):
        return written(_resampled(docs, labels, seed), keep=True)


def _resampled(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("clean"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS).toPandas()
    share = float((known["fine"] & known["clean"]).mean()) if len(known) else 1.0
    good = {int(x) for x in known.loc[known["fine"] & known["clean"], "doc_id"]}
    weights = fit(docs, good)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", log_weight(F.col("text"), weights).alias("log_weight"), (-F.log(-F.log(u))).alias("noise"))
    rows = written(rows.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key")))
    n = rows.count()
    k = min(n, round(share * n))
    least = kth_largest(rows, "key", k) if k else float("inf")
    return rows.withColumn("selected", F.col("key") >= least)
