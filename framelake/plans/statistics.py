"""Queries on statistics, normalization, sampling, top-k, batching and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import information as N
from framelake.operators import registry as R
from framelake.operators import selection as P
from framelake.operators import statistics as S
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, REGISTRY_SQL, frames, load, registry

_DIMS = "d AS (SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
_STATS = "s AS (SELECT label, dim, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.01) AS q1, quantile_cont(v, 0.99) AS q99, quantile_cont(v, 0.02) AS ql, quantile_cont(v, 0.98) AS qh FROM d GROUP BY label, dim)"


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


@query("A1 A2", f"WITH {_DIMS} SELECT label AS embodiment, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(median(v), 6) AS median, round(quantile_cont(v, 0.01), 6) AS q1, round(quantile_cont(v, 0.99), 6) AS q99, round(quantile_cont(v, 0.0001), 6) AS q0_01, round(quantile_cont(v, 0.9999), 6) AS q99_99 FROM d GROUP BY label, dim")
def vector_norm_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.rounded(S.norm_stats(_dims(spark, d).withColumnRenamed("label", "embodiment"), ["embodiment", "dim"], "v"))


@query("N1 N2 J15 R29 X31", f"""WITH {_DIMS}, {_STATS} SELECT vec_id, CAST(d.dim AS INTEGER) AS dim, round((v - mean) / (std + 1e-6), 6) AS z, round(2 * (v - lo) / (hi - lo + 1e-6) - 1, 6) AS mm, round(2 * (v - q1) / (q99 - q1 + 1e-6) - 1, 6) AS q, round(v, 6) AS back
FROM d JOIN s ON s.label = d.label AND s.dim = d.dim""")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    df = _dims(spark, d)
    stats = S.norm_stats(df, ["label", "dim"], "v").select("label", "dim", F.struct("mean", "std", "min", "max", "q1", "q99").alias("s"))
    df = df.join(stats, ["label", "dim"])
    z = S.normalize(F.col("v"), F.col("s"), "zscore")
    return df.select("vec_id", "dim", F.round(z, 6).alias("z"), F.round(S.normalize(F.col("v"), F.col("s"), "minmax"), 6).alias("mm"), F.round(S.normalize(F.col("v"), F.col("s"), "quantile"), 6).alias("q"), F.round(S.unnormalize(z, F.col("s"), "zscore"), 6).alias("back"))


@query("N3 A25", f"""WITH {_DIMS}, {_STATS}, b AS (SELECT vec_id, min(CASE WHEN v < ql - 0.01 THEN d.dim * 2 WHEN v > qh + 0.01 THEN d.dim * 2 + 1 END) AS bad FROM d JOIN s ON s.label = d.label AND s.dim = d.dim GROUP BY vec_id)
SELECT vec_id, bad IS NOT NULL AS rejected, CASE WHEN bad % 2 = 0 THEN 'low' WHEN bad % 2 = 1 THEN 'high' END AS reason FROM b""")
def bounds_check(spark: SparkSession, d: str) -> DataFrame:
    df = _dims(spark, d)
    stats = df.groupBy("label", "dim").agg((F.percentile("v", 0.02) - 0.01).alias("low"), (F.percentile("v", 0.98) + 0.01).alias("high"))
    df = df.join(stats, ["label", "dim"]).withColumn("r", S.reject_reason(F.col("v"), F.col("low"), F.col("high")))
    first = F.min_by("r", F.when(F.col("r").isNotNull(), F.col("dim")))
    return df.groupBy("vec_id").agg(first.alias("reason")).select("vec_id", F.col("reason").isNotNull().alias("rejected"), "reason")


@query("N4 D17", f"""WITH {FRAMES_SQL}, m AS (SELECT episode, min(value) AS lo, max(value) AS hi FROM frames GROUP BY episode)
SELECT f.episode, t, round(CASE WHEN hi - lo < 100 THEN coalesce((value - lo) / nullif(hi - lo, 0), 0) ELSE value END, 6) AS value FROM frames f JOIN m ON m.episode = f.episode""")
def gripper_rescale(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d)
    ends = df.groupBy("episode").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return df.join(ends, "episode").select("episode", "t", F.round(F.when(F.col("hi") - F.col("lo") < 100, scaled).otherwise(F.col("value")), 6).alias("value"))


@query("A3 Q12", f"WITH {_DIMS} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 0.1), 6) AS std FROM d GROUP BY label, dim")
def gaussian_fit(spark: SparkSession, d: str) -> DataFrame:
    return _dims(spark, d).groupBy("label", "dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("v"), F.lit(0.1)), 6).alias("std"))


@query("A4 A5", """WITH s AS (SELECT source AS task, doc_id, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 1000 END AS mi FROM documents)
SELECT coalesce(task, 'ALL') AS task, count(mi) AS n, round(avg(mi), 6) AS mean, round(stddev_pop(mi), 6) AS std, round(median(mi), 6) AS median, min(mi) AS min, max(mi) AS max FROM s GROUP BY ROLLUP (task)""")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents").select(F.col("source").alias("task"), F.when(F.col("doc_id") % 31 == 0, float("nan")).otherwise(F.col("n_chars") / 1000).alias("mi"))
    df = df.withColumn("mi", F.nanvl("mi", F.lit(None).cast("double")))
    out = df.rollup("task").agg(F.count("mi").alias("n"), F.round(F.avg("mi"), 6).alias("mean"), F.round(F.stddev_pop("mi"), 6).alias("std"), F.round(F.median("mi"), 6).alias("median"), F.min("mi").alias("min"), F.max("mi").alias("max"))
    return out.withColumn("task", F.coalesce("task", F.lit("ALL")))


@query("A12", "SELECT coalesce(lang, 'TOTAL') AS split, coalesce(source, 'TOTAL') AS dataset, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS frames FROM documents GROUP BY ROLLUP (lang, source)")
def split_totals(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("frames"))
    return df.select(F.coalesce("lang", F.lit("TOTAL")).alias("split"), F.coalesce("source", F.lit("TOTAL")).alias("dataset"), "n", "frames")


@query("A14 W14", f"WITH {FRAMES_SQL}, g AS (SELECT episode, value - lag(value) OVER (PARTITION BY episode ORDER BY t) AS dv, value FROM frames) SELECT episode, round(var_samp(value), 4) AS var_value, round(var_samp(dv), 4) AS var_step FROM g GROUP BY episode")
def motion_variance(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("value") - F.lag("value").over(Window.partitionBy("episode").orderBy("t"))
    return frames(spark, d).withColumn("dv", step).groupBy("episode").agg(F.round(F.var_samp("value"), 4).alias("var_value"), F.round(F.var_samp("dv"), 4).alias("var_step"))


@query("A15", """WITH w AS (SELECT event_type, value FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT min(value) AS lo, max(value) AS hi FROM w),
h AS (SELECT event_type, least(49, CAST(floor((value - lo) * 50 / (hi - lo)) AS INTEGER)) AS bin FROM w, r),
p AS (SELECT bin, count(*) / sum(count(*)) OVER () AS s FROM h WHERE event_type = 'click' GROUP BY bin), q AS (SELECT bin, count(*) / sum(count(*)) OVER () AS s FROM h WHERE event_type = 'view' GROUP BY bin),
j AS (SELECT coalesce(p.s, 0) + 1e-10 AS p, coalesce(q.s, 0) + 1e-10 AS q FROM p FULL JOIN q ON p.bin = q.bin), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM j) SELECT round(sum(p * ln(p / q)), 6) AS kl FROM n""")
def histogram_divergence(spark: SparkSession, d: str) -> DataFrame:
    """All values of both kinds in bins with shared edges, from their smallest to their largest."""
    h = S.shared_histogram(load(spark, d, "events").filter("event_type IN ('click', 'view')"), ["event_type"], "value", 50)
    one = lambda k: h.filter(F.col("event_type") == k).select("bin", "n")
    return S.kl_divergence(one("click"), one("view"), "bin").select(F.round("kl", 6).alias("kl"))


@query("A17 A18 R9", """SELECT o_orderpriority AS team, round(avg(o_totalprice / 1000), 6) AS mean_score, round(sum(coalesce(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE CAST(o_totalprice AS STRING) END AS DOUBLE), 0)) / coalesce(nullif(max(o_custkey % 3), 0), 1) / count(*), 4) AS aggregate FROM orders GROUP BY 1""")
def team_scores(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.col("o_totalprice").cast("string"))
    norm = F.coalesce(F.nullif(F.max(F.col("o_custkey") % 3), F.lit(0)), F.lit(1))
    total = F.sum(F.coalesce(text.try_cast("double"), F.lit(0.0)))
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("team")).agg(F.round(F.avg(F.col("o_totalprice") / 1000), 6).alias("mean_score"), F.round(total / norm / F.count(F.lit(1)), 4).alias("aggregate"))


@query("A20 A21 A23 E1", """WITH p AS (SELECT a.label, list_reduce(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2), lambda x, y: x + y) / 64 AS mse, (a.embedding[64]::DOUBLE - b.embedding[64]::DOUBLE) ** 2 AS last FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, count(*) AS n, round(avg(mse), 6) AS paired_mse, round(avg(last), 6) AS final_mse, round(avg(CASE WHEN mse > 0.03 THEN 1.0 ELSE 0.0 END), 6) AS mismatch FROM p GROUP BY label""")
def paired_errors(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    other = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    mse = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("x")
    last = F.pow(F.element_at("x", -1) - F.element_at("y", -1), 2)
    pairs = df.join(other, "vec_id").select("label", mse.alias("mse"), last.alias("last"))
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mse"), 6).alias("paired_mse"), F.round(F.avg("last"), 6).alias("final_mse"), F.round(F.avg((F.col("mse") > 0.03).cast("double")), 6).alias("mismatch"))


_SCORES = "s AS (SELECT source AS task, doc_id, CASE WHEN source = 'src3' AND doc_id % 50 = 23 THEN NULL ELSE (doc_id * 7919 % 1009) / 1009.0::DOUBLE END AS mi FROM documents)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    mi = F.when((F.col("source") == "src3") & (F.col("doc_id") % 50 == 23), F.lit(None)).otherwise((F.col("doc_id") * 7919 % 1009) / 1009.0)
    return load(spark, d, "documents").select(F.col("source").alias("task"), "doc_id", mi.alias("mi"))


@query("T2 K16", f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY mi DESC NULLS LAST, doc_id) AS r, count(*) OVER (PARTITION BY task) AS n, count(*) FILTER (mi IS NULL) OVER (PARTITION BY task) AS bad FROM s)
SELECT task, doc_id, mi FROM r WHERE bad > 0 OR r <= greatest(1, ceil(n * 0.2))""")
def curated_top_share(spark: SparkSession, d: str) -> DataFrame:
    return S.top_share(_scores(spark, d), "task", "mi", "doc_id", 0.2)


@query("T1 R14", f"WITH {_SCORES} SELECT task, doc_id, CAST(row_number() OVER (PARTITION BY task ORDER BY mi DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.top_rows(_scores(spark, d), ["task"], [F.desc_nulls_last("mi"), F.col("doc_id")], 5).select("task", "doc_id", "rank")


@query("T4 T3", "SELECT page_id, CAST(row_number() OVER (ORDER BY length(url) - length(replace(url, '/', '')), url, page_id) AS INTEGER) AS position FROM pages QUALIFY position <= 100")
def depth_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred by depth and name: a top-k report."""
    first = load(spark, d, "pages").orderBy(F.size(F.split("url", "/")), "url", "page_id").limit(100)
    return R.top_rows(first.withColumn("_all", F.lit(1)), ["_all"], [F.size(F.split("url", "/")), F.col("url"), F.col("page_id")], 100).select("page_id", F.col("rank").alias("position"))


@query("T12 S19")
def seeded_splits(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a seeded permutation by hash: no sort, and smaller samples are part of larger ones."""
    df = S.split(load(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 0.2)
    return S.hash_rank(df, ["doc_id"], 7).withColumn("in_tenth", F.col("u") < 0.1).drop("u")


@query("T13 T15 S14 S15", "SELECT doc_id, doc_id % 8 AS shard, doc_id // 100 AS chunk, CAST(floor(doc_id * 4.0 / (SELECT max(doc_id) + 1 FROM documents)) AS BIGINT) AS quarter FROM documents")
def shards(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents").select("doc_id")
    n = df.agg((F.max("doc_id") + 1).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("doc_id", F.pmod("doc_id", F.lit(8)).alias("shard"), F.floor(F.col("doc_id") / 100).alias("chunk"), F.floor(F.col("doc_id") * 4.0 / F.col("n")).alias("quarter"))


@query("T14", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS r FROM orders),
f AS (SELECT o_custkey, o_orderkey, r, 0 AS batch, p AS s FROM o WHERE r = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN f.s > 0 AND f.s + o.p > 300000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.s > 0 AND f.s + o.p > 300000 THEN o.p ELSE f.s + o.p END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1)
SELECT o_custkey, o_orderkey, batch FROM f""")
def size_bounded_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.size_batches(load(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice", 300000.0).select("o_custkey", "o_orderkey", "batch")


@query("T16 M5 R26", "SELECT doc_id, (doc_id * 617 + 11) % (SELECT count(*) FROM documents) AS plan_idx FROM documents WHERE ((doc_id * 617 + 11) % (SELECT count(*) FROM documents) - 900 + (SELECT count(*) FROM documents)) % (SELECT count(*) FROM documents) < 250 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def epoch_window(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of one window of an epoch's permutation, wrapping around, without the bad ones."""
    df = load(spark, d, "documents").select("doc_id")
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("n")))
    plan = df.crossJoin(n).withColumn("plan_idx", (F.col("doc_id") * 617 + 11) % F.col("n"))
    bad = load(spark, d, "labels").filter("toxic = 1")
    return R.choose(plan.filter("pmod(plan_idx - 900, n) < 250"), "doc_id", exclude=[bad]).select("doc_id", "plan_idx")


@query("T18", """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) SELECT l.lang, s.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN n ON n.lang = l.lang AND n.source = s.source""")
def bars_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    axes = counts.select("lang").distinct().crossJoin(counts.select("source").distinct())
    return axes.join(counts, ["lang", "source"], "left").fillna(0, ["n"])


_PAIR = "e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), p AS (SELECT a.label, a.vec_id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM e a JOIN e b ON b.label = a.label AND b.vec_id <> a.vec_id)"


@query("Q8 Q11 J17 J18", f"""WITH {_PAIR}, k AS (SELECT label, vec_id, list_sort(list(d))[3] * (1 - 1e-10) AS eps, count(*) AS m FROM p GROUP BY label, vec_id),
c AS (SELECT k.label, k.vec_id, k.m, count(*) FILTER (p.dx < k.eps) AS nx, count(*) FILTER (p.dy < k.eps) AS ny FROM k JOIN p ON p.vec_id = k.vec_id GROUP BY k.label, k.vec_id, k.m)
SELECT label, vec_id, round(1.5 - coalesce(list_sum(list_transform(range(1, nx + 1), lambda i: 1.0::DOUBLE / i)), 0) - coalesce(list_sum(list_transform(range(1, ny + 1), lambda i: 1.0::DOUBLE / i)), 0) + list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)), 6) AS mi FROM c""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: F.array(F.col("embedding")[i].cast("double"))
    df = load(spark, d, "embeddings").select("label", "vec_id", one(0).alias("x"), one(1).alias("y"))
    return N.ksg(df, "label", "vec_id", "x", "y", [3]).select("label", "vec_id", F.round("mi", 6).alias("mi"))


_HALVES = "h AS (SELECT label, vec_id, list_transform(embedding[1:32], lambda v: v::DOUBLE) AS x, list_transform(embedding[33:], lambda v: v::DOUBLE) AS y, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) <= count(*) OVER () // 2 AS ref FROM embeddings)"


def _apart(c: str) -> str:
    return f"list_max(list_transform(list_zip(a.{c}, b.{c}), lambda z: abs(z[1] - z[2])))"


def _ksg_sql(ks: str, other: str, least: str) -> str:
    h = lambda n: f"coalesce(list_sum(list_transform(range(1, {n} + 1), lambda i: 1.0::DOUBLE / i)), 0)"
    return f"""WITH {_HALVES}, p AS (SELECT a.label, a.vec_id, {_apart("x")} AS dx, {_apart("y")} AS dy FROM h a JOIN h b ON b.label = a.label AND {other}),
l AS (SELECT label, vec_id, list_sort(list(greatest(dx, dy))) AS l, count(*) AS n FROM p GROUP BY label, vec_id), k AS (SELECT unnest({ks}) AS k),
e AS (SELECT label, vec_id, n, k, l[k + 1] * (1 - 1e-10) AS eps FROM l, k WHERE n > {least}),
c AS (SELECT e.vec_id, e.n, e.k, greatest(count(*) FILTER (p.dx < e.eps) - 1, 0) AS nx, greatest(count(*) FILTER (p.dy < e.eps) - 1, 0) AS ny FROM e JOIN p ON p.vec_id = e.vec_id GROUP BY e.vec_id, e.n, e.k),
m AS (SELECT vec_id, avg({h("(k - 1)")} - {h("nx")} - {h("ny")} + {h("(n - 1)")}) AS mi FROM c GROUP BY vec_id)
SELECT h.label, h.vec_id, round(m.mi, 6) AS mi FROM h LEFT JOIN m ON m.vec_id = h.vec_id"""


def _halves(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    ranked = P.permuted(load(spark, d, "embeddings"), "vec_id").withColumn("ref", F.col("rank") < F.expr("n div 2"))
    return ranked.select("label", "vec_id", F.slice(x, 1, 32).alias("x"), F.slice(x, 33, 32).alias("y"), "ref")


@query("Q8 Q9 Q11 J17 J18", _ksg_sql("[3, 4, 5, 6, 7]", "TRUE", "7"))
def mutual_information_averaged(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of whole vectors, averaged over 3 to 7 neighbours."""
    return N.ksg(_halves(spark, d), "label", "vec_id", "x", "y", [3, 4, 5, 6, 7]).withColumn("mi", F.round("mi", 6))


@query("Q10", _ksg_sql("[5]", "b.ref", "5"))
def mutual_information_by_sample(spark: SparkSession, d: str) -> DataFrame:
    """All rows against the half of them that a seeded permutation puts first; sampling the reference is the feature."""
    return N.ksg(_halves(spark, d), "label", "vec_id", "x", "y", [5], "ref").withColumn("mi", F.round("mi", 6))


@query("J19 E4", f"WITH {_PAIR} SELECT a.vec_id, arg_min(b.vec_id, abs(a.x - b.x)) AS nearest FROM e a JOIN e b ON b.label = a.label AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id")
def nearest_pairing(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return S.nearest_value(df.filter("vec_id % 2 = 0"), df.filter("vec_id % 2 = 1"), "label", "vec_id", "x").select("vec_id", F.col("other").alias("nearest"))


@query("A26 Q5 Q6 Q7 S30 R18", """WITH f AS (SELECT user_id, event_type AS feature, arg_max(value, event_id) AS v, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT u.user_id, k.feature, f.v, f.n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'view', 'error']) AS feature) k LEFT JOIN f ON f.user_id = u.user_id AND f.feature = k.feature),
s AS (SELECT user_id, feature, CASE WHEN n IS NULL THEN 'MISSING' WHEN n % 7 = 0 THEN 'VERSION_MISMATCH' WHEN v > 60 THEN 'FAILED' ELSE 'OK' END AS status FROM g)
SELECT user_id, count(*) FILTER (status = 'OK') AS n_ok, bool_and(status = 'OK') AS done, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (status NOT IN ('OK', 'FAILED')), '') AS to_process FROM s GROUP BY user_id""")
def feature_status(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    wanted = e.select("user_id").distinct().withColumn("feature", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("error"))))
    have = e.groupBy("user_id", F.col("event_type").alias("feature")).agg(F.max_by("value", "event_id").alias("v"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") % 7 == 0, "VERSION_MISMATCH").when(F.col("v") > 60, "FAILED").otherwise("OK")
    df = wanted.join(have, ["user_id", "feature"], "left").withColumn("status", status)
    todo = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("status").isin("OK", "FAILED"), F.col("feature")))), ",")
    return df.groupBy("user_id").agg(F.count_if(F.col("status") == "OK").alias("n_ok"), F.every(F.col("status") == "OK").alias("done"), todo.alias("to_process"))
