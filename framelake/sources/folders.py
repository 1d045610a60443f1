"""Folders of small files whose layouts drift: CSV with other headers in each file, and files with their companions."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that files use for fields of the registry.
ALIASES = {"collector": "operator", "clothes_info": "objects", "clothes": "objects", "scene_number": "scene"}
_ROWS = pa.schema([("path", pa.string()), ("row", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])


def _parsed(aliases: dict[str, str], first_only: bool, delimiter: str | None):  # noqa: ANN202
    def rows_of(text: str) -> Iterator[dict[str, str]]:
        if delimiter is None:
            lines = (line.split() for line in text.splitlines())
        else:
            lines = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
        filled = (x for x in lines if any(v.strip() for v in x))
        header = [aliases.get(h.strip(), h.strip()) for h in next(filled, [])]
        for values in filled:
            yield {h: v.strip() for h, v in zip(header, values, strict=False) if h}
            if first_only:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(rows_of(content.as_py().decode("utf-8-sig", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([list(r.items()) for r in rows], _ROWS.field("fields").type)], schema=_ROWS)

    return run


def read_drifting(spark: SparkSession, path: str, glob: str = "*_meta.csv", aliases: dict[str, str] | None = None, first_only: bool = False, delimiter: str | None = ",") -> DataFrame:
    """All files below path that match glob, each with a header of its own, as rows (path, row, fields): one job whatever the
    number of files. The header is a file's first line that isn't blank; names are trimmed and go through the aliases, and of
    two columns with one name the later one counts. Blank rows are left out; a row's missing values are missing from fields,
    and surplus ones are dropped. first_only keeps each file's first row. delimiter None splits at white space."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parsed(ALIASES if aliases is None else aliases, first_only, delimiter), "path string, row long, fields map<string,string>")


def columns_of(rows: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Named fields as columns, null where a file lacks them."""
    return rows.select(*keep, *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def listed(field: Column) -> Column:
    """Values parted by commas as an array without blanks; empty for a blank or missing field."""
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def with_rewritten(files: DataFrame, suffix: str, companion: str) -> DataFrame:
    """Of a listing (path), files that end in suffix and beside which a file stands whose name has companion in its place."""
    own = files.filter(F.col("path").endswith(suffix)).withColumn("_needs", F.concat(F.expr(f"left(path, length(path) - {len(suffix)})"), F.lit(companion)))
    return own.join(files.select(F.col("path").alias("_needs")), "_needs", "left_semi").drop("_needs")


def groups(files: DataFrame, meta: str = "_meta.csv", main: str = ".vrs", side: str = ".json") -> DataFrame:
    """For each file of a listing (path) whose name ends in meta: meta_path, base, main_path and side_path. The main file
    stands in the same folder; its name is base + main, in lower or upper case, or else begins with base and ends in main in
    any case (the first by name). A file without a main one is left out; side_path, the main path + side, may be null.

    Nothing is compared pair by pair: a main file is joined by those starts of its name that are as long as some base in its
    folder, at most as many as a name has characters, and only the best file for each start meets the metadata files."""
    f = files.select("path", _folder(F.col("path")).alias("_dir"), _name(F.col("path")).alias("_file"))
    metas = f.filter(F.col("_file").endswith(meta)).select(F.col("path").alias("meta_path"), "_dir", F.expr(f"left(_file, length(_file) - {len(meta)})").alias("base")).distinct()
    lengths = metas.groupBy("_dir").agg(F.collect_set(F.length("base")).alias("_lengths"))
    stem = F.expr(f"left(_file, length(_file) - {len(main)})")
    mains = f.filter(F.lower("_file").endswith(main)).select(F.col("path").alias("main_path"), "_dir", "_file", stem.alias("_stem"))
    starts = mains.join(lengths, "_dir").withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_stem")))).withColumn("base", F.expr("left(_stem, _n)"))
    exact = F.when(F.col("_file") == F.concat("base", F.lit(main)), 0).when(F.col("_file") == F.concat("base", F.lit(main.upper())), 1).otherwise(2)
    best = starts.groupBy("_dir", "base").agg(F.min(F.struct(exact.alias("rank"), "main_path")).alias("_m"))
    best = metas.join(best, ["_dir", "base"]).select("meta_path", "base", "_m.main_path").withColumn("side_path", F.concat("main_path", F.lit(side)))
    there = files.select(F.col("path").alias("side_path"), F.lit(True).alias("_there"))
    return best.join(there, "side_path", "left").select("meta_path", "base", "main_path", F.when(F.col("_there"), F.col("side_path")).alias("side_path"))
