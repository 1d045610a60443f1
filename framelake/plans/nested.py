"""Queries on nested documents: statuses at any depth, leaves of records, changes deep inside a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import nested as N
from framelake.functions import variants as V
from framelake.plans.registry import query
from framelake.plans.standins import load

FEATURES = ("click", "view", "error")
_STATUS = "CASE WHEN value > 180 THEN 'FAILED' WHEN value > 90 THEN 'WARNING' ELSE 'SUCCESS' END"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """A JSON summary of each user's events of a kind. Stages nest in different ways, by event; one in eleven doesn't parse."""
    e = load(spark, d, "events").withColumn("s", F.expr(_STATUS))
    said = lambda before, after: F.concat(F.lit(before), "s", F.lit(after))
    flat = said('{"status": "', '", "detail": null}')
    deep = said('{"detail": {"steps": [{"status": "', '"}, {"state": "none"}], "n": 2}}')
    deeper = said('{"rounds": [[{"run": {"status": "', '", "tries": 1}}], []]}')
    stage = F.when(F.col("event_id") % 3 == 0, flat).when(F.col("event_id") % 3 == 1, deep).otherwise(deeper)
    docs = e.groupBy("user_id", F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.collect_list(stage), ",").alias("stages"))
    text = F.concat(F.lit('{"version": "'), (F.col("n") % 7).cast("string"), F.lit('", "stages": ['), "stages", F.lit("]"))
    return docs.select("user_id", "feature", F.when(F.col("n") % 11 == 0, text).otherwise(F.concat(text, F.lit("}"))).alias("summary"))


@query("A26 Q5 Q6 Q7 R18", f"""WITH f AS (
  SELECT user_id, event_type AS feature, count(*) AS n, count(*) FILTER ({_STATUS} = 'FAILED') AS bad FROM events GROUP BY ALL),
w AS (SELECT u.user_id, k.feature FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest({list(FEATURES)}) AS feature) k),
s AS (
  SELECT w.user_id, w.feature, CASE WHEN n IS NULL OR n % 11 = 0 THEN 'MISSING' WHEN n % 7 <> 1 AND n % 7 <> 2 THEN 'VERSION_MISMATCH' WHEN bad > 0 THEN 'FAILED' ELSE 'OK' END AS status
  FROM w LEFT JOIN f ON f.user_id = w.user_id AND f.feature = w.feature),
p AS (SELECT user_id, event_type AS feature FROM events WHERE value > 250)
SELECT user_id, feature, status, status <> 'OK' AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.feature = s.feature) AS needed FROM s""")
def nested_status(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of recordings from summaries without a schema, judged at every depth, and which features are to be processed:
    those that aren't OK and haven't failed before."""
    docs = _summaries(spark, d).withColumn("doc", F.try_parse_json("summary"))
    version = F.expr("try_variant_get(doc, '$.version', 'string')")
    good = F.when(version.isin("1", "2"), version).otherwise("1")
    status = F.when(F.col("doc").isNull(), "MISSING").when(version != good, "VERSION_MISMATCH")
    status = status.otherwise(F.when((F.size(V.nested_values("doc", "status")) > 0) & ~V.all_among("doc", "status", ["SUCCESS", "WARNING"]), "FAILED").otherwise("OK"))
    judged = docs.select("user_id", "feature", status.alias("status"))
    e = load(spark, d, "events")
    wanted = e.select("user_id").distinct().withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    df = wanted.join(judged, ["user_id", "feature"], "left").withColumn("status", F.coalesce("status", F.lit("MISSING")))
    failed = e.filter("value > 250").select("user_id", F.col("event_type").alias("feature")).distinct()
    todo = df.filter("status <> 'OK'").join(failed, ["user_id", "feature"], "left_anti").select("user_id", "feature", F.lit(True).alias("needed"))
    return df.join(todo, ["user_id", "feature"], "left").withColumn("needed", F.coalesce("needed", F.lit(False)))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested records: lines in order, and their prices by supplier."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_returnflag").alias("flag"), F.array("l_discount", "l_tax").alias("rates")).alias("terms"))
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.struct("o_orderpriority", F.col("o_custkey").alias("customer")).alias("head"))
    return o.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


_LINES = "l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_discount, l_tax) - 1 AS VARCHAR) AS place FROM lineitem)"


@query("X21 X16 R16", f"""WITH {_LINES}, j AS (SELECT o_orderkey, o_orderpriority, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f AS (SELECT o_orderkey, 'head.o_orderpriority' AS path, o_orderpriority AS value FROM j UNION ALL SELECT o_orderkey, 'head.customer', CAST(o_custkey AS VARCHAR) FROM j
  UNION ALL SELECT l_orderkey, 'lines.' || place || '.no', CAST(l_linenumber AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, 'lines.' || place || '.quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM l
  UNION ALL SELECT l_orderkey, 'lines.' || place || '.terms.flag', l_returnflag FROM l
  UNION ALL SELECT l_orderkey, 'lines.' || place || '.terms.rates.0', CAST(l_discount AS VARCHAR) FROM l UNION ALL SELECT l_orderkey, 'lines.' || place || '.terms.rates.1', CAST(l_tax AS VARCHAR) FROM l)
SELECT o_orderkey, path, CASE WHEN path LIKE '%rates%' THEN CAST(round(CAST(value AS DOUBLE), 4) AS VARCHAR) ELSE value END AS value FROM f""")
def leaves_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Nested records, lists included, as rows of path and value."""
    rows = N.flattened_lists(_orders(spark, d), ["o_orderkey"], ["head", "lines"])
    number = F.col("value").cast("double")
    value = F.when(F.col("path").like("%rates%"), F.round(number, 4).cast("string")).when(F.col("path").like("%quantity"), number.cast("long").cast("string")).otherwise(F.col("value"))
    return rows.withColumn("value", value)


@query("X23 X22 R22", f"""WITH {_LINES} SELECT l_orderkey AS o_orderkey, CAST(count(*) AS INTEGER) AS n_lines, round(sum(l_quantity * 2), 4) AS doubled, round(sum(l_discount * 2 + l_tax * 2), 6) AS rates, round(max(o.o_totalprice) * 2, 4) AS total,
  string_agg(lower(l_returnflag), '' ORDER BY l_linenumber, l_quantity, l_returnflag, l_discount, l_tax) AS flags, lower(max(o.o_orderpriority)) AS priority
FROM l JOIN orders o ON o.o_orderkey = l_orderkey GROUP BY l_orderkey""")
def deep_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every double at any depth doubled and every text in lower case, then read back from the nested columns."""
    df = N.deep_mapped(N.deep_mapped(_orders(spark, d), T.DoubleType, lambda c: c * 2), T.StringType, F.lower)
    rates = N.over_time(F.col("lines"), lambda x: F.aggregate(x["terms"]["rates"], F.lit(0.0), lambda s, r: s + r))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return df.select(
        "o_orderkey", F.size("lines").alias("n_lines"), F.round(total(F.transform("lines", lambda x: x["quantity"])), 4).alias("doubled"), F.round(total(rates), 6).alias("rates"),
        F.round("o_totalprice", 4).alias("total"), F.array_join(F.transform("lines", lambda x: x["terms"]["flag"]), "").alias("flags"), F.col("head.o_orderpriority").alias("priority"),
    )
