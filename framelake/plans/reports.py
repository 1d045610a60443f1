"""Queries on files that runs leave behind, table rows, key names and substitutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import reports as R
from framelake.plans.registry import query
from framelake.plans.standins import load
from framelake.plans.statistics import _SCORES, _scores
from framelake.sources.scratch import steps


@query("X19", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '_1' ELSE source || '_1_t' END AS key, CASE WHEN doc_id % 2 = 0 THEN source || '_1' ELSE source || '_1_t_1' END AS first,
  CASE WHEN doc_id % 2 = 0 THEN source || '_t' ELSE source || '_1_t_t' END AS now, CASE WHEN doc_id % 2 = 0 THEN source || '_T' ELSE source || '_1_t_T' END AS last FROM documents""")
def key_triples(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("_1"))).otherwise(F.concat("source", F.lit("_1_t")))
    return load(spark, d, "documents").select("doc_id", key.alias("key")).withColumn("k", R.key_triple(F.col("key"))).select("doc_id", "key", "k.*")


@query("T19 R28", """WITH d AS (SELECT doc_id, lang, doc_id % 9 = 4 AS bad, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
n AS (SELECT *, first_value(CASE WHEN NOT bad THEN doc_id END IGNORE NULLS) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  first_value(CASE WHEN NOT bad THEN doc_id END IGNORE NULLS) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM d)
SELECT lang, doc_id, coalesce(after, first) AS other FROM n WHERE bad""")
def substitutes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that failed, each with a seeded choice among the good ones of its group."""
    return R.fallbacks(load(spark, d, "documents"), "lang", "doc_id", F.col("doc_id") % 9 == 4)


@query("K24 X26", """WITH s AS (SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'O') / count(*)::DOUBLE AS a, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE END AS b FROM orders GROUP BY o_orderpriority),
t AS (SELECT p, a, b, printf('%.1f', round(a * 100, 1)) AS x, printf('%.1f', round(b * 100, 1)) AS y FROM s)
SELECT p AS task, replace(p, '-', ' ') || ' & ' || CASE WHEN a >= coalesce(b, a) THEN '\\textbf{' || x || '}' ELSE x END || ' & ' || CASE WHEN b IS NULL THEN '--' WHEN b >= a THEN '\\textbf{' || y || '}' ELSE y END || ' \\\\' AS line FROM t""")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    """Shares of two kinds of orders side by side as lines of a table."""
    share = lambda s: F.count_if(F.col("o_orderstatus") == s) / F.count(F.lit(1))
    df = load(spark, d, "orders").groupBy("o_orderpriority").agg(share("O").alias("a"), share("F").alias("b")).withColumn("b", F.when(~F.col("o_orderpriority").like("5%"), F.col("b")))
    lines = R.table_rows(df.withColumn("task", F.replace("o_orderpriority", F.lit("-"), F.lit("_"))), "task", "a", "b")
    return lines.join(df.select("o_orderpriority", F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("task")), "task").select(F.col("o_orderpriority").alias("task"), "line")


@query("K15 S37", f"""WITH {_SCORES} SELECT s.task, CAST(s.doc_id AS VARCHAR) AS episode, round(s.mi, 6) AS score, t.n AS count, round(t.a, 6) AS mi_mean, round(t.d, 6) AS mi_std, round(t.m, 6) AS mi_median
FROM s JOIN (SELECT task, count(*) AS n, avg(mi) AS a, stddev_pop(mi) AS d, median(mi) AS m FROM s GROUP BY task) t ON t.task = s.task""")
def scores_saved_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Scores by task and their statistics as JSON, written and read again."""
    with steps(spark) as own:
        R.save_scores(_scores(spark, d), "task", "doc_id", "mi", f"{own.path}/scores")
        rows, stats = R.load_scores(spark, f"{own.path}/scores")
        df = rows.join(stats, "task")
        return own.result(df.select("task", "episode", F.round("score", 6).alias("score"), "count", *[F.round(c, 6).alias(c) for c in ("mi_mean", "mi_std", "mi_median")]))


@query("K20 A27", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS frames, round(sum(n_chars * 0.25), 4) AS seconds FROM documents GROUP BY lang")
def timings_appended(spark: SparkSession, d: str) -> DataFrame:
    """Conversion timings of two runs appended to one folder of CSV files and summed by embodiment."""
    docs = load(spark, d, "documents")
    rows = docs.select(F.concat(F.coalesce("lang", F.lit("?")), F.lit("/"), F.col("doc_id").cast("string")).alias("episode_key"), F.lit("a, b").alias("processed_path"), F.lit(None).cast("string").alias("mp4_path"), F.col("n_chars").cast("long").alias("num_frames"), (F.col("n_chars") * 0.25).alias("duration_sec"))
    with steps(spark) as own:
        for half in (0, 1):
            R.append_timings(rows.filter(F.pmod(F.hash("episode_key"), F.lit(2)) == half), f"{own.path}/timings")
        lang = F.nullif(F.split("episode_key", "/")[0], F.lit("?")).alias("lang")
        got = R.read_timings(spark, f"{own.path}/timings").groupBy(lang).agg(F.count(F.lit(1)).alias("n"), F.sum("num_frames").alias("frames"), F.round(F.sum("duration_sec"), 4).alias("seconds"))
        return own.result(got)
