"""Operator 5, substring dedup by hashing lines and the sentences in them.

A unit is a sentence of a line. Units are normalised (lower case, white space runs to one space, trimmed) and hashed to
64 bits. Digests are grouped globally: pre-aggregated counts and the smallest doc_id. A unit is a repeat when its digest
stands in a document with a smaller id or earlier in its own text. Repeats that follow each other in a text form a run;
runs of at least MIN_WORDS words are removed and all else stays, so short phrases that many documents share are left
alone. Removed ranges keep the offsets of the original text, and each names the document that keeps the first copy of its
start. Digests that stand once are sorted out by a filter of fixed size before units are joined with counts.

Null and empty texts have no units. Rows with one doc_id are one document: its units don't repeat each other, but offsets
belong to each text. A null doc_id ranks last. Other columns stay as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import join_hot, lean, maybe_in, scratch, written

MIN_WORDS = 20
STOP = re.compile(r"(?:[.!?](?=\s)|\n)[^\S\n]*\n?")  # where a unit ends
_UNITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("key", pa.int64()), ("again", pa.bool_()), ("seq", pa.int32())])
_RUNS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("first_doc_id", pa.int64())])


def split_units(text: str) -> Iterator[tuple[int, int, int, int, bool]]:
    """(start, end, number of words, digest, whether it stood before in this text) of the units, which cover the text
    without gaps; blank ones are left out."""
    seen = set()
    at = 0
    for end in (*(m.end() for m in STOP.finditer(text)), len(text)):
        if words := text[at:end].lower().split():
            key = xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)
            yield at, end, len(words), key, key in seen
            seen.add(key)
        at = end


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, doc, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            row, doc = row.as_py(), doc.as_py()
            rows += [(row, doc, *u, k) for k, u in enumerate(split_units(text.as_py() or ""))]
            if len(rows) > 50_000:
                yield _batch(rows, _UNITS)
                rows = []
        yield _batch(rows, _UNITS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive repeats of a text, joined."""
    for batch in batches:
        out = []
        for row, doc, units in zip(*(batch.column(k) for k in range(3)), strict=True):  # the units of one text at a time
            row, doc = row.as_py(), doc.as_py()
            run: list[dict] = []
            for u in [*units.as_py(), None]:
                if run and (u is None or u["seq"] != run[-1]["seq"] + 1):
                    if (n := sum(x["words"] for x in run)) >= MIN_WORDS:
                        out.append((row, doc, run[0]["start"], run[-1]["end"], n, run[0]["first_doc_id"]))
                    run = []
                if u:
                    run.append(u)
        yield _batch(out, _RUNS)


def row_key() -> Column:
    """Tells rows with one doc_id apart by their text."""
    return F.xxhash64("doc_id", "text")


def repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to the removed ranges: row, doc_id, start, end, words, first_doc_id."""
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        units = written(rows.mapInArrow(lean(_units), "row long, doc_id long, start int, end int, words int, key long, again boolean, seq int"))
        counts = units.groupBy("key").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        counts = written(counts)
        found = written(units.filter(maybe_in(counts, "key")(F.col("key"))))
        found = join_hot(found, counts, "key").filter(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
        one = F.struct("seq", "start", "end", "words", "first_doc_id")
        by_row = found.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(one)).alias("u"))
        return written(by_row.mapInArrow(lean(_runs), "row long, doc_id long, start int, end int, words int, first_doc_id long"), keep=True)


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with the repeats taken out of text, and n_chars counted anew where there is one and the text changed."""
    with scratch(docs.sparkSession):
        spans = written(repeats(docs).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")), keep=True)
    kept = F.expr("""aggregate(_spans, named_struct('at', 0, 'out', ''),
        (s, x) -> named_struct('at', x.end, 'out', concat(s.out, substring(text, s.at + 1, x.start - s.at))),
        s -> concat(s.out, substring(text, s.at + 1)))""")
    docs = docs.withColumn("_row", row_key())
    may = docs.withColumn("_may", maybe_in(spans, "row")(F.col("_row")))
    same = may.filter(~F.col("_may")).drop("_may", "_row")  # most texts need no join, so they aren't shuffled
    out = may.filter("_may").drop("_may").join(spans.withColumnRenamed("row", "_row"), "_row", "left")
    out = out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return same.unionByName(out.select(*same.columns))
