"""Interval, as-of and neighbour joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(df: DataFrame, steps: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins one after the other; how each is run is left to the optimizer's sizes."""
    for right, key in steps:
        df = df.join(right, key, "left")
    return df


def _binned(spans: DataFrame, closed: str, width: int) -> DataFrame:
    """A row for each bin that a span touches; what a span costs grows with its length over the bins' width."""
    last = F.col("end_idx") if closed == "both" else F.col("end_idx") - 1
    kept = spans.withColumn("_last", last).filter(F.col("_last") >= F.col("start_idx"))
    return kept.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_idx") / width), F.floor(F.col("_last") / width))))


def interval_join(frames: DataFrame, spans: DataFrame, closed: str = "left", pick: str = "all", width: int = 64) -> DataFrame:
    """frames (episode, t) with the spans (episode, ordinal, start_idx, end_idx, text) that hold t.

    closed: 'left' for [start, end), 'both' for [start, end]. pick: 'all' gives texts, an array by ordinal; 'first' and
    'last' give text. Frames in no span keep an empty array or null. Frames meet only spans of their bin, by an
    equi-join on (episode, bin)."""
    marked = _binned(spans, closed, width).select("episode", "_bin", "ordinal", "start_idx", "_last", F.col("text").alias("_text"))
    hits = frames.select("episode", "t").withColumn("_bin", F.floor(F.col("t") / width)).join(marked, ["episode", "_bin"]).filter("t BETWEEN start_idx AND _last")
    grouped = hits.groupBy("episode", "t")
    if pick == "all":
        found = grouped.agg(F.sort_array(F.collect_list(F.struct("ordinal", "_text"))).alias("_s"))
        found = found.select("episode", "t", F.col("_s._text").alias("texts"))
        return frames.join(found, ["episode", "t"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    take = F.min_by if pick == "first" else F.max_by
    return frames.join(grouped.agg(take("_text", "ordinal").alias("text")), ["episode", "t"], "left")


def with_previous(labelled: DataFrame) -> DataFrame:
    """text where there is none: the last one before in the episode, else the first one after."""
    w = Window.partitionBy("episode").orderBy("t")
    back = F.last("text", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("text", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return labelled.withColumn("text", F.coalesce(back, ahead))


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, tolerance: Column | None = None) -> DataFrame:
    """Each left row with the value of the right row nearest in time; of two as near, the earlier.

    Both sides are united and sorted once; each left row looks back and ahead, so there is no range join."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_t": F.lit(None).cast(right.schema[on].dataType)})
    b = right.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(on).alias("_t"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_m", F.when(F.col("_side") == 0, F.struct("_t", "_v")))
    w = Window.partitionBy(*by).orderBy(on, "_side")
    back = F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_b", back).withColumn("_a", ahead).filter("_side = 1")
    near = F.when(F.col("_a").isNull() | (F.col(on) - F.col("_b._t") <= F.col("_a._t") - F.col(on)), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_n", near)
    if tolerance is not None:
        out = out.withColumn("_n", F.when(F.abs(F.col(on) - F.col("_n._t")) <= tolerance, F.col("_n")))
    return out.select(*left.columns, F.col("_n._t").alias("matched_at"), F.col("_n._v").alias(value))


def first_prefix_match(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Pairs in which one text begins with the other, the first right text for each left one. Texts of at least
    `width` meet by an equi-join of their heads; a shorter one meets the heads of its length of all texts on the other side."""
    l, r = left.withColumn("_h", F.substring(a, 1, width)), right.withColumn("_h", F.substring(b, 1, width))
    long = l.filter(F.length(a) >= width).join(r.filter(F.length(b) >= width), "_h").filter(F.col(a).startswith(F.col(b)) | F.col(b).startswith(F.col(a)))
    heads = lambda df, c: df.withColumn("_h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.substring(c, 1, k)))).distinct()
    hits = long.select(a, b)
    hits = hits.unionAll(l.filter(F.length(a) < width).join(heads(r, b), "_h").select(a, b)).unionAll(r.filter(F.length(b) < width).join(heads(l, a), "_h").select(a, b))
    return hits.groupBy(a).agg(F.min(b).alias(b))
