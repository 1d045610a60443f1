"""Queries over splits, samples, key maps, syncs and small array operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import interp
from framelake.operators import selection as P
from framelake.operators import statistics as S
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, REGISTRY_SQL, frames, load, registry

_RANKED = "r AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return P.permuted(load(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query("T5 T6 T7 T8 T12 S19", f"""WITH {_RANKED}, v AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS k, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS p FROM r)
SELECT 'valid' AS mode, doc_id FROM v WHERE rank < k UNION ALL SELECT 'train', doc_id FROM v WHERE rank >= k UNION ALL SELECT 'percent', doc_id FROM v WHERE rank < p UNION ALL SELECT 'total', doc_id FROM v""")
def split_modes(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    parts = [P.by_mode(ranked, m, 0.2, 0.1).select(F.lit(m).alias("mode"), "doc_id") for m in ("valid", "train", "percent", "total")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("T9 T10 T11", f"WITH {_RANKED} SELECT doc_id, rank FROM r WHERE rank < least(greatest(1, ceil(n * 0.05)), n, 200000)")
def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    return P.sample(_ranked(spark, d), 0.05, 200_000).select("doc_id", "rank")


@query("T16 M5", f"WITH {_RANKED} SELECT doc_id, rank FROM r WHERE (rank - n // 2 - n // 4 + n) % n < least(n // 2, n)")
def permutation_window(spark: SparkSession, d: str) -> DataFrame:
    """Half of the permutation from three quarters on, wrapping around."""
    n = load(spark, d, "documents").count()
    return P.window_of(_ranked(spark, d), n // 2 + n // 4, n // 2).select("doc_id", "rank")


@query("T13 T15 S14 S15", f"WITH {_RANKED} SELECT doc_id, rank % 8 AS shard, rank // 100 AS chunk, rank * 4 // n AS quarter FROM r")
def ranked_shards(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("doc_id", F.pmod("rank", F.lit(8)).alias("shard"), F.expr("rank div 100").alias("chunk"), F.expr("rank * 4 div n").alias("quarter"))


@query("T20", """WITH a AS (SELECT doc_id AS a_id, row_number() OVER (ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
b AS (SELECT page_id AS b_id, row_number() OVER (ORDER BY md5('2:' || CAST(page_id AS VARCHAR)), page_id) - 1 AS r FROM pages),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb), s AS (SELECT unnest(range(0, greatest(na, nb))) AS step, na, nb FROM n)
SELECT step, a_id, b_id FROM s JOIN a ON a.r = step % na JOIN b ON b.r = step % nb""")
def cycled_loaders(spark: SparkSession, d: str) -> DataFrame:
    a = P.permuted(load(spark, d, "documents").select(F.col("doc_id").alias("a_id")), "a_id", 1)
    b = P.permuted(load(spark, d, "pages").select(F.col("page_id").alias("b_id")), "b_id", 2)
    return P.cycled([a, b]).select("step", "a_id", "b_id")


@query("T17", """SELECT o_orderpriority AS team, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS INTEGER) AS place FROM orders GROUP BY o_orderpriority""")
def categorical_order(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("team")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", P.in_order(F.col("team"), ["5-LOW", "1-URGENT", "3-MEDIUM"])).orderBy("place", "team")


_SCHEMATIC = "m AS (SELECT DISTINCT source AS embodiment, 'obs_' || lang AS key, source || '.' || lang AS storage_key, CASE WHEN lang = 'en' THEN 'actions' ELSE 'proprio' END AS kind FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def _schematic(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "actions").otherwise("proprio")
    return load(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select(F.col("source").alias("embodiment"), F.concat(F.lit("obs_"), "lang").alias("key"), F.concat_ws(".", "source", "lang").alias("storage_key"), kind.alias("kind")).distinct()


@query("F13", f"WITH {_SCHEMATIC} SELECT embodiment, key, kind FROM m WHERE kind = 'proprio'")
def keys_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return P.keys_of(_schematic(spark, d), kind="proprio").select("embodiment", "key", "kind")


@query("F14", f"WITH {_SCHEMATIC}, w AS (SELECT doc_id, coalesce(source, '') AS embodiment, coalesce(source, '') || '.' || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE coalesce(lang, '') END AS storage_key FROM documents) SELECT doc_id, m.key FROM w LEFT JOIN m ON m.embodiment = w.embodiment AND m.storage_key = w.storage_key")
def names_of_storage_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").selectExpr("doc_id", "coalesce(source, '') AS embodiment", "coalesce(source, '') || '.' || CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE coalesce(lang, '') END AS storage_key")
    return P.to_names(rows, _schematic(spark, d)).select("doc_id", "key")


@query("F9 F11 F12", f"WITH {REGISTRY_SQL} SELECT episode_hash AS id, num_frames AS frames FROM registry")
def key_mapped(spark: SparkSession, d: str) -> DataFrame:
    renamed = P.by_key_map(registry(spark, d), {"id": "episode_hash", "frames": "num_frames", "who": "operator"})
    return P.without(renamed, ["who"])


@query("A15", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT event_type, least(49, CAST(floor((value - lo) * 50 / (hi - lo)) AS INTEGER)) AS bin FROM events, b)
SELECT event_type, bin, count(*) AS n FROM h WHERE bin IS NOT NULL GROUP BY event_type, bin""")
def shared_edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_histogram(load(spark, d, "events"), ["event_type"], "value", 50)


@query("A19", "SELECT l_orderkey, l_linenumber, round((l_discount + CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END) / 2, 6) AS ood FROM lineitem")
def mean_of_two(spark: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("l_linenumber") != 3, F.col("l_tax"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((F.col("l_discount") + b) / 2, 6).alias("ood"))


@query("A27 A23", f"""WITH {_RANKED}, p AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS share) SELECT CAST(share AS DOUBLE) AS share, source, count(*) AS episodes, CAST(sum(n_chars) AS BIGINT) AS frames FROM r JOIN p ON rank < greatest(1, CAST(floor(n * CAST(share AS DOUBLE)) AS BIGINT)) GROUP BY share, source""")
def frames_by_percent(spark: SparkSession, d: str) -> DataFrame:
    shares = F.array(*[F.struct(F.lit(s).alias("share"), P.share_of(F.col("n"), s).alias("k")) for s in (0.1, 0.25, 0.5, 1.0)])
    rows = _ranked(spark, d).withColumn("s", F.explode(shares)).filter("rank < s.k")
    return rows.groupBy(F.col("s.share").alias("share"), "source").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n_chars").alias("frames"))


@query("A10 U8", f"""WITH {FRAMES_SQL}, b AS (SELECT DISTINCT episode, t FROM (SELECT episode, t FROM frames WHERE value < 20 UNION ALL SELECT episode, t FROM frames WHERE kind = 'error' UNION ALL SELECT episode, t FROM frames WHERE t % 10 = 0 AND value > 100))
SELECT episode, count(*) AS n_bad, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS bad FROM b GROUP BY episode""")
def bad_indices(spark: SparkSession, d: str) -> DataFrame:
    """Frames that any of several keys marks as bad, each once."""
    f = frames(spark, d)
    marks = [f.filter(c).select("episode", "t") for c in ("value < 20", "kind = 'error'", "t % 10 = 0 AND value > 100")]
    bad = marks[0].unionAll(marks[1]).unionAll(marks[2]).groupBy("episode").agg(F.sort_array(F.collect_set("t")).alias("l"))
    return bad.select("episode", F.size("l").cast("long").alias("n_bad"), F.array_join(F.col("l").cast("array<string>"), ",").alias("bad"))


@query("U7", "WITH l AS (SELECT doc_id, [coalesce(lang, '-'), coalesce(source, '-'), lower(coalesce(lang, '-')), upper(coalesce(source, '-')), coalesce(source, '-')] AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS texts FROM l")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The base text first, then variants that aren't there yet."""
    lang, source = F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))
    texts = F.array_distinct(F.concat(F.array(lang), F.array(source, F.lower(lang), F.upper(source), source)))
    return load(spark, d, "documents").select("doc_id", F.array_join(texts, "|").alias("texts"))


@query("X22", "SELECT conv_id, array_to_string(list(coalesce(role, '') ORDER BY turn), '|') AS roles, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def lists_of_fields(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation as one list for each field."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return rows.select("conv_id", F.array_join("l.role", "|").alias("roles"), F.aggregate("l.n", F.lit(0).cast("long"), lambda s, v: s + v).alias("chars"))


@query("X30", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN list_extract(l, 1) WHEN doc_id % 3 = 1 THEN list_extract(l, CAST(doc_id * 31 % len(l) + 1 AS BIGINT)) END, 'default') AS prompt FROM (SELECT doc_id, [lang, source, lang || source] AS l FROM documents)")
def prompt_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first, a seeded one, or the default."""
    texts = F.array("lang", "source", F.concat("lang", "source"))
    at = (F.col("doc_id") * 31 % F.size(texts) + 1).cast("int")
    picked = F.when(F.col("doc_id") % 3 == 0, F.element_at(texts, 1)).when(F.col("doc_id") % 3 == 1, F.element_at(texts, at))
    return load(spark, d, "documents").select("doc_id", F.coalesce(picked, F.lit("default")).alias("prompt"))


@query("W17 I1", """WITH g AS (SELECT vec_id, embedding[1:32] AS a FROM embeddings), i AS (SELECT vec_id, a, unnest(range(0, 64)) AS i FROM g), p AS (SELECT *, i * 31.0::DOUBLE / 63 AS pos FROM i)
SELECT vec_id, round(sum((a[CAST(floor(pos) AS BIGINT) + 1]::DOUBLE + (pos - floor(pos)) * (a[least(CAST(floor(pos) AS BIGINT) + 2, 32)]::DOUBLE - a[CAST(floor(pos) AS BIGINT) + 1]::DOUBLE)) * (i + 1)), 4) AS weighted FROM p GROUP BY vec_id""")
def slowed_down(spark: SparkSession, d: str) -> DataFrame:
    """A chunk at half the speed: its first half over the whole length, with all values in one weighted sum."""
    x = F.col("embedding").cast("array<double>")
    slow = load(spark, d, "embeddings").select("vec_id", interp.linear(F.slice(x, 1, 32), 64).alias("s"))
    terms = F.transform("s", lambda v, i: v * (i + 1))
    return slow.select("vec_id", F.round(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), 4).alias("weighted"))


@query("Q3", "SELECT vec_id, coalesce(bool_and(abs(embedding[i]) < 0.2) FILTER (i <= 32), false) AS left_still, coalesce(bool_and(abs(embedding[i]) < 0.2) FILTER (i > 32), false) AS right_still FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY vec_id")
def still_arms(spark: SparkSession, d: str) -> DataFrame:
    """Whether all actions of an arm in a chunk are near zero."""
    still = lambda at: F.forall(F.slice("embedding", at, 32), lambda v: F.abs(v) < F.lit(0.2).cast("double"))
    return load(spark, d, "embeddings").select("vec_id", still(1).alias("left_still"), still(33).alias("right_still"))


@query("A24", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) AS total, list_max(embedding)::DOUBLE AS most, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding), 6) AS mean FROM embeddings")
def reduced_vectors(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return load(spark, d, "embeddings").select("vec_id", F.round(total, 5).alias("total"), F.array_max(x).alias("most"), F.round(total / F.size(x), 6).alias("mean"))


@query("R6", f"WITH {REGISTRY_SQL} SELECT episode_hash, CASE WHEN doc_id % 5 = 0 OR doc_id % 4 > 1 THEN '' ELSE zarr_processed_path END AS path FROM registry")
def stale_paths(spark: SparkSession, d: str) -> DataFrame:
    """A preview: paths over a day old or of unknown age are blank."""
    age = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 4).cast("double"))
    return registry(spark, d).select("episode_hash", P.stale(F.col("zarr_processed_path"), age, 1.0).alias("path"))


@query("R7", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def objects_to_sync(spark: SparkSession, d: str) -> DataFrame:
    remote = load(spark, d, "documents").select("doc_id", "n_chars")
    local = remote.filter("doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return P.to_sync(remote, local, "doc_id", "n_chars")


@query("K14 N6", "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[1]::DOUBLE), 6) AS std FROM embeddings GROUP BY label")
def saved_state(spark: SparkSession, d: str) -> DataFrame:
    """Statistics as JSON text and read again."""
    x = F.col("embedding")[0].cast("double")
    state = load(spark, d, "embeddings").groupBy("label").agg(F.to_json(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))).alias("j"))
    back = state.select("label", F.from_json("j", "mean double, std double").alias("s"))
    return back.select("label", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query("N5", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:3], lambda v: v::DOUBLE ** 2))), 5) AS length FROM embeddings")
def projected_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Three channels through the projection of width three or less, which keeps them: their length."""
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    y = P.projected(x, P.projection(3, 8, 0))
    return load(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v)), 5).alias("length"))


@query("N5")
def projected_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors on eight seeded orthonormal directions; tested against numpy, as SQL has no QR."""
    x = F.col("embedding").cast("array<double>")
    width = load(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 1
    return load(spark, d, "embeddings").select("vec_id", P.projected(x, P.projection(width, 8, 0)).alias("y"))
