"""Operator 12, mixing sources to target weights by capped water-filling.

A source's size is the number of words of its texts. The budget, a share of all sizes, is dealt out by weight; a source that
gets more than its maximum of epochs is held there and what it got too much goes to the others by weight, until none is
above. A source's target is then met by whole repetitions of all its documents and one seeded part of a repetition: in the
order of a hash of id and text, documents are taken once more until the target is reached, the last one in part.

Nothing is sorted as a whole: keys of a source are counted in bins of about BIN rows, only the bin in which the part ends is
looked at key by key, and a document compares its key with the one where its source's part ends. Source rows are joined by
broadcast up to SMALL sources, beyond by join_hot, so that a source with a third of all rows isn't shuffled to one task.

A null source is a source of its own, the last one; a null text has no words; a null id counts as the empty string in the
hash. Rows with the same source, id and text have one key and are taken alike: where a part ends among them, each gives the
same number of words, and the source misses its target by less than one word for each such row. A source without words has
the target 0. An empty table gives no rows. Columns other than doc_id, text and source are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import join_hot, scratch, written
from framelake.llm.scan import first_words, word_count

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 42
BIN, SMALL, RANGES = 2000, 20_000, 200
#: keys are the first 15 hexadecimal digits of a digest
_BITS = 60


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source): doc_id, text, k (the source, never null), key and size."""
    k = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", "text", k.alias("k"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"), word_count(F.col("text")).alias("size"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank from 0 by code point, the null source last: ranges of names are numbered one by one."""
    last = F.col("k") == ""
    parts = min(RANGES, 1 + sources.count() // SMALL)
    ranges = written(sources.repartitionByRange(parts, last, "k").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").count().orderBy("part").collect()  # a row for each range
    before = [0]
    for r in sizes:
        before.append(before[-1] + r["count"])
    start = F.create_map(*[F.lit(x) for r, b in zip(sizes, before, strict=False) for x in (r["part"], b)]) if sizes else F.create_map(F.lit(0), F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy(last, "k"))
    return ranges.withColumn("rank", (number - 1 + start[F.col("part")]).cast("long")).drop("part")


def filled(sources: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """sources (k, source_size, n_rows) with target: each round holds the sources above their most and raises the level."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = written(_ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(epochs)))
    held, n_held = F.lit(False), -1
    while True:
        got = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(held, F.col("most"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("weight"), F.count_if(held).alias("n")).first()
        rest = share * (got["total"] or 0) - (got["held"] or 0.0)
        level = rest / got["weight"] if got["weight"] else float("inf")
        target = F.least(F.col("most"), F.col("weight") * level)
        if got["n"] == n_held or not got["weight"]:
            return s.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(0.0))
        n_held, held = got["n"], F.col("weight") * level >= F.col("most")


def _joined(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(sources), "k") if small else join_hot(rows, sources, "k")


def _crossing(df: DataFrame, by: str) -> DataFrame:
    """Of rows (k, by, size, rest), one for each value of by, the first whose running size reaches rest; before is that of
    the ones in front."""
    upto = F.sum("size").over(Window.partitionBy("k").orderBy(by))
    return df.withColumn("before", upto - F.col("size")).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).select("k", by, "before", "size", "rest")


def planned(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, bool]:
    """rows: sized() as a written table. A row for each source: k, source_size, target, whole (repetitions of all
    documents), edge (the key where the part ends), before (words of the part before that key), tie (words at that key) and
    rest (words of the part); and whether there are few sources."""
    sources = rows.groupBy("k").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    s = filled(sources, weights, share, epochs)
    words = F.floor(F.col("target") + 0.5)
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)).withColumn("rest", words - F.col("whole") * F.col("source_size"))
    s = written(s.select("k", "source_size", "target", "whole", "rest", F.least(F.lit(1 << 22), F.expr(f"n_rows div {BIN} + 1")).alias("bins")))
    small = s.count() <= SMALL
    low = F.shiftright(F.shiftright("key", _BITS - 40) * F.col("bins"), 40)
    parts = _joined(rows.select("k", "key", "size"), s.filter("rest > 0").select("k", "rest", "bins"), small).withColumn("bin", low)
    binned = parts.groupBy("k", "bin").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    last = written(_crossing(binned, "bin").select("k", "bin", F.col("before").alias("ahead")))
    inside = parts.join(F.broadcast(last) if small else last, ["k", "bin"]).groupBy("k", "key").agg(F.sum("size").alias("size"), F.first(F.col("rest") - F.col("ahead")).alias("rest"))
    ends = _crossing(inside, "key").select("k", F.col("key").alias("edge"), (F.col("rest") - F.col("before")).alias("left"), F.col("size").alias("tie"))
    return written(s.drop("rest", "bins").join(ends, "k", "left")), small


def taken(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """rows (doc_id, k, key, size, ...) with source_size, target, copies (whole repetitions) and extra (words of a part of
    the document taken besides)."""
    df = _joined(rows, sources, small)
    more = F.when(F.col("key") < F.col("edge"), F.col("size")).when(F.col("key") == F.col("edge"), F.floor(F.col("left") * F.col("size") / F.col("tie"))).otherwise(0)
    df = df.withColumn("_more", F.coalesce(more, F.lit(0)).cast("long"))
    full = (F.col("_more") > 0) & (F.col("_more") == F.col("size"))
    return df.withColumn("copies", F.col("whole").cast("long") + full.cast("long")).withColumn("extra", F.when(full, 0).otherwise(F.col("_more")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, extra. One row a document."""
    with scratch(docs.sparkSession):
        rows = written(sized(docs, seed).drop("text"))
        sources, small = planned(rows, weights, share, epochs)
        out = taken(rows, sources, small)
        done = out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"), "copies", "extra")
        return written(done, keep=True)


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: doc_id, source, copy (from 0) and text, a row for each repetition; the last may be part of a text."""
    with scratch(docs.sparkSession):
        sources, small = planned(written(sized(docs, seed).drop("text")), weights, share, epochs)
        sources = written(sources, keep=True)
    out = taken(sized(docs, seed), sources, small).withColumn("_n", F.col("copies") + (F.col("extra") > 0).cast("long")).filter("_n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    part = F.col("copy") == F.col("copies")
    text = F.coalesce(F.when(part, first_words(F.when(part, F.col("text")), F.col("extra"))).otherwise(F.col("text")), F.lit(""))
    source = F.when(F.col("k") != "", F.substring(F.col("k"), 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), "copy", text.alias("text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size,
  CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, sum(2.0::DOUBLE * source_size) OVER p - 2.0::DOUBLE * source_size AS held, sum(w) OVER () - sum(w) OVER p + w AS free, sum(source_size) OVER () * 1.5::DOUBLE AS budget, row_number() OVER p AS place
  FROM s WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(arg_min((budget - held) / free, place) FILTER (w * ((budget - held) / free) < 2.0 * source_size), 'infinity'::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * level) AS target FROM s, l),
u AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t),
r AS (SELECT d.doc_id, d.size, d.key, u.source_size, u.target, coalesce(u.words // nullif(u.source_size, 0), 0) AS whole, coalesce(u.words % nullif(u.source_size, 0), 0) AS rest, d.source FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY source, key) AS tie FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + CASE WHEN upto <= rest THEN size WHEN upto - tie < rest THEN floor((rest - (upto - tie)) * size / tie) ELSE 0 END AS BIGINT) AS taken,
  CAST(whole + CASE WHEN size > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(CASE WHEN upto > rest AND upto - tie < rest THEN floor((rest - (upto - tie)) * size / tie) ELSE 0 END AS BIGINT) AS extra FROM c
"""
