"""Operator 3, embedding near-dedup by NN-descent.

Equal vectors form one class. Each class starts with a list of its nearest classes inside small windows of several orders;
an order sorts by the signs of random projections, so near vectors often stand near. Rounds of NN-descent follow: every
class meets the neighbours of its neighbours, in both directions, and keeps the nearest K. All pairs that meet with a cosine
of at least THRESHOLD, in double precision, join classes to components before lists are cut; what leaves a task is a
spanning forest of them. A list whose K entries all are of the own component is saturated: it is enlarged by the K nearest
of other components. Inside a component cosines are counted in blocks of rows, so no list of pairs is ever made.

An audit compares a bounded sample of classes, a new one for each search, with all others. Recall is the share of sampled
classes whose links all lie inside their component, in the worst of three strata by number of links, so that one large
group can't hide what is lost elsewhere. Links that are found missing are added, and below RECALL the search goes on with
new orders, at most SEARCHES times; then all pairs are compared in parts.

Vectors that are null, empty or zero, or hold null or non-finite components link with nothing, nor do vectors of different
length. Labels play no part. Repeated rows are equal vectors; a row without vec_id links with nothing."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import components, join_hot, joined_rows, scratch, written

THRESHOLD, RECALL = 0.9, 0.999
K, ORDERS, DESCENTS, SEARCHES = 6, 8, 3, 4
WINDOW, BLOCK, SAMPLE, PART = 256, 512, 1000, 4096
OWN, OTHER, LINK = 0, 1, 2  # kinds of edges: inside a component, out of it, and what joins two
_EDGE = "u long, v long, sim float, kind int"
log = logging.getLogger(__name__)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, with a digest of the vector as it stands; null where a vector can't link."""
    for batch in batches:
        unit, digest = [], []
        for key, v in zip(batch.column(0), batch.column(1), strict=True):
            x = np.array(v.as_py(), dtype=np.float64) if v.is_valid and v.values.null_count == 0 and key.is_valid else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not (np.isfinite(x).all() and top > 0):
                unit.append(None)
                digest.append(None)
                continue
            x = x / top  # neither overflows nor vanishes when squared
            unit.append((x / np.sqrt((x * x).sum())).tobytes())
            digest.append(xxhash.xxh3_64_intdigest((np.array(v.as_py(), dtype=np.float64) + 0.0).tobytes()) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.binary()), pa.array(digest, pa.int64())], ["vec_id", "unit", "digest"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, a row each."""
    rows = [np.frombuffer(x, dtype=np.float64) for x in column.to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, 1))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches, in parts of at most `most` rows."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        cols = [held.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = [0, *edge.tolist()]
        for a, b in zip(at, at[1:], strict=False):
            for k in range(a, b, most):
                yield held.slice(k, min(most, b - k))
        rest = at[-1]
        while held.num_rows - rest >= most:
            yield held.slice(rest, most)
            rest += most
        held = held.slice(rest)
    if held is not None and held.num_rows:
        yield held


def _nearest(ids: np.ndarray, x: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, ...]:
    """u, v, sim, kind of rows that meet: the K nearest of each row, and for a row whose K nearest all are of its own
    component the K nearest of others too. Every pair that passes counts: links join the rows that it connects."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    label = joined_rows((s >= THRESHOLD) | (root[:, None] == root[None, :]))
    other = label[:, None] != label[None, :]
    k = min(K, len(ids))
    new = np.flatnonzero(root != root[label])
    parts = [(ids[new], ids[label[new]], np.ones(len(new)), np.full(len(new), LINK))]
    full = np.arange(len(ids))
    for t in (s, np.where(other, s, -2.0)):
        top = np.argpartition(-t[full], k - 1, axis=1)[:, :k]
        row = np.repeat(full, k)
        top, sim = top.ravel(), np.take_along_axis(t[full], top, 1).ravel()
        ok = sim > -1.5
        row, top, sim = row[ok], top[ok], sim[ok]
        parts.append((ids[row], ids[top], sim, np.where(other[row, top], OTHER, OWN)))
        full = np.setdiff1d(full, row[other[row, top]])
        if not len(full):
            break
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _edges(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The K nearest of each row and kind, and all links."""
    none = np.zeros(0, np.int64)
    u, v, s, kind = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (none, none, np.zeros(0), none)
    s = s.astype(np.float32)
    at = np.lexsort((v, -s, kind, u))
    u, v, s, kind = u[at], v[at], s[at], kind[at]
    if len(u):
        first = np.append(True, (u[1:] != u[:-1]) | (kind[1:] != kind[:-1]) | (v[1:] != v[:-1]))
        u, v, s, kind = u[first], v[first], s[first], kind[first]
        start = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (kind[1:] != kind[:-1])))
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        ok = (rank < K) | (kind == LINK)
        u, v, s, kind = u[ok], v[ok], s[ok], kind[ok]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(kind.astype(np.int32))], ["u", "v", "sim", "kind"])


def _first_lists(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """Edges inside windows of several orders. Orders are dealt by range, so a crowded region spreads over tasks."""
    bits = int(min(40, max(1, np.ceil(np.log2(max(2, n / WINDOW))))))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array([len(x.as_py()) // 8 for x in batch.column(1)])
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(1))
                for o in range(ORDERS):
                    g = planes.setdefault(dim, np.random.default_rng([seed, dim]).standard_normal((ORDERS, dim, bits + 1)))[o]
                    p = x @ g
                    code = ((p[:, :bits] > 0) << np.arange(bits)).sum(1)
                    size = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, o)), pa.array(np.full(size, dim)), pa.array(code.astype(np.int64)), pa.array(p[:, bits]), part.column(0), part.column(1), part.column(2)], ["o", "dim", "code", "p", "d", "unit", "root"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for part in _groups(batches, ["o", "dim"], WINDOW // 2):
            now = (part.column("o")[0].as_py(), part.column("dim")[0].as_py(), part.column("d").to_numpy(), _matrix(part.column("unit")), part.column("root").to_numpy())
            both = held is not None and held[:2] == now[:2]
            out.append(_nearest(*(np.concatenate([x, y]) if both else y for x, y in zip(held[2:] if both else now[2:], now[2:], strict=True))))
            held = now
            if len(out) >= 64:
                yield _edges(out)
                out = []
        yield _edges(out)

    rows = vectors.select("d", "unit", "root").mapInArrow(order, "o long, dim long, code long, p double, d long, unit binary, root long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "o", "dim", "code", "p").sortWithinPartitions("o", "dim", "code", "p")
    return rows.mapInArrow(windows, _EDGE)


def _lists(edges: DataFrame) -> DataFrame:
    """u, v, sim, kind: the K nearest of each class; where all of these are of its own component the list is saturated, and
    grows by the K nearest of other components; and the links."""
    one = F.struct(F.round("sim", 4).alias("sim"), "v", "kind")
    kept = edges.groupBy("u").agg(F.sort_array(F.collect_set(one), False).alias("l"))
    kept = kept.withColumn("own", F.expr(f"transform(filter(l, x -> x.kind = {OWN}), x -> x.v)"))
    kept = kept.withColumn("all", F.expr(f"array_distinct(transform(filter(l, x -> x.kind <> {LINK}), x -> named_struct('sim', x.sim, 'v', x.v, 'kind', IF(array_contains(own, x.v), {OWN}, {OTHER}))))"))
    kept = kept.withColumn("near", F.slice("all", 1, K))
    kept = kept.withColumn("far", F.expr(f"IF(forall(near, x -> x.kind = {OWN}), slice(filter(all, x -> x.kind = {OTHER}), 1, {K}), slice(all, 1, 0))"))
    kept = kept.select("u", F.explode(F.expr(f"concat(near, far, filter(l, x -> x.kind = {LINK}))")).alias("e"))
    return kept.select("u", "e.v", "e.sim", "e.kind")


def _descend(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges between classes that have a neighbour in common, in either direction."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part in _groups(batches, ["center", "dim"], WINDOW):
            if part.num_rows > 1:
                out.append(_nearest(part.column("d").to_numpy(), _matrix(part.column("unit")), part.column("root").to_numpy()))
                if len(out) >= 256:
                    yield _edges(out)
                    out = []
        yield _edges(out)

    pairs = lists.select(F.col("u").alias("center"), F.col("v").alias("d")).unionAll(lists.select(F.col("v").alias("center"), F.col("u").alias("d"))).unionAll(vectors.select(F.col("d").alias("center"), "d")).distinct()
    # centres with very many members are met in parts
    rows = pairs.join(vectors.select("d", "unit", "root"), "d").select("center", "d", "unit", "root", (F.length("unit")).cast("long").alias("dim"))
    return rows.repartition("center").sortWithinPartitions("center", "dim", F.xxhash64("d")).mapInArrow(meet, _EDGE)


def _found(met: DataFrame) -> DataFrame:
    return met.filter(f"kind = {LINK}").select(F.col("u").alias("a"), F.col("v").alias("b"))


def _placed(vectors: DataFrame, links: DataFrame) -> DataFrame:
    """vectors with the component of each class, itself where it has no link."""
    roots = components(links).withColumnRenamed("node", "d")
    return written(vectors.drop("root").join(roots, "d", "left").withColumn("root", F.coalesce("root", "d")))


def _sample(vectors: DataFrame, seed: int) -> DataFrame:
    """A bounded sample of classes, a new one for each seed."""
    return vectors.select("d", "unit", "root").orderBy(F.xxhash64("d", F.lit(seed)), "d").limit(SAMPLE)


def _against_all(vectors: DataFrame, some: DataFrame) -> DataFrame:
    """some (d, unit, root), a bounded number of classes, against all others. Rows u, v, total, lost: links that join all
    components that linked pairs join (v not null), and for each class of some how many links it has and how many of them
    lead out of its component."""
    rows = some.toPandas()
    by_dim = {dim: (r["d"].to_numpy(), r["root"].to_numpy(), np.stack([np.frombuffer(x) for x in r["unit"]])) for dim, r in rows.groupby(rows["unit"].map(len))}
    shared = vectors.sparkSession.sparkContext.broadcast(by_dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x.as_py()) for x in batch.column(1)])
            for dim, (q, root, x) in shared.value.items():
                part = batch.filter(pa.array(dims == dim))
                if not part.num_rows:
                    continue
                d, own = part.column(0).to_numpy(), part.column(2).to_numpy()
                near = (_matrix(part.column(1)) @ x.T >= THRESHOLD) & (d[:, None] != q[None, :])
                out = near & (own[:, None] != root[None, :])
                total, lost = near.sum(0), out.sum(0)
                up: dict[int, int] = {}  # components joined so far in this batch

                def find(c: int) -> int:
                    while (top := up.get(c, c)) != c:
                        up[c] = up.get(top, top)
                        c = top
                    return c

                links = []
                for i, k in zip(*np.nonzero(out), strict=True):
                    one, two = find(int(own[i])), find(int(root[k]))
                    if one != two:
                        up[one] = two
                        links.append((int(q[k]), int(d[i])))
                u = [e[0] for e in links] + q[total > 0].tolist()
                v = [e[1] for e in links] + [None] * int((total > 0).sum())
                zero = [0] * len(links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(zero + total[total > 0].tolist(), pa.int64()), pa.array(zero + lost[total > 0].tolist(), pa.int64())], ["u", "v", "total", "lost"])

    return written(vectors.select("d", "unit", "root").mapInArrow(search, "u long, v long, total long, lost long"))


def _recall(found: DataFrame) -> float:
    """The share of classes that keep all their links, in the worst stratum of classes with 1, at most K, and more links."""
    own = found.filter("v IS NULL").groupBy("u").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"))
    strata = own.groupBy(F.expr(f"CASE WHEN total = 1 THEN 0 WHEN total <= {K} THEN 1 ELSE 2 END AS stratum"))
    return min((r["whole"] for r in strata.agg(F.avg((F.col("lost") == 0).cast("double")).alias("whole")).collect()), default=1.0)  # a row for each stratum


def _joining(found: DataFrame) -> DataFrame:
    return found.filter("v IS NOT NULL").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _exact(vectors: DataFrame, n: int) -> DataFrame:
    """Links that join what is still apart, from all pairs: parts of bounded size go against the whole table in turn."""
    parts = -(-n // PART)
    part = F.pmod(F.xxhash64("d", F.lit(-1)), F.lit(parts))
    links = None
    for k in range(parts):
        found = _joining(_against_all(vectors, vectors.filter(part == k)))
        links = found if links is None else links.unionAll(found)
    return links


def _counted(vectors: DataFrame, roots: DataFrame) -> DataFrame:
    """d, n: linked vectors in other classes of the component. A component is cut to blocks and each pair of blocks is
    multiplied in one task; only counts leave it."""
    inside = vectors.join(roots.withColumnRenamed("node", "d"), "d")
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = inside.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.length("unit").alias("dim"), "own", "d", "unit", "copies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ["root", "i", "j", "dim"], 1 << 30):
            own, d, w = part.column("own").to_numpy(), part.column("d").to_numpy(), part.column("copies").to_numpy()
            x = _matrix(part.column("unit"))
            a = own == part.column("i")[0].as_py()
            if a.all():
                n = ((x @ x.T >= THRESHOLD) & (d[:, None] != d[None, :])) @ w
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n)], ["d", "n"])
            else:
                s = x[a] @ x[~a].T >= THRESHOLD
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[a], d[~a]])), pa.array(np.concatenate([s @ w[~a], s.T @ w[a]]))], ["d", "n"])

    keys = ["root", "i", "j", "dim"]
    counts = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "d long, n long")
    return counts.groupBy("d").agg(F.sum("n").alias("n"))


def near_vectors(table: DataFrame) -> DataFrame:
    """table (vec_id, embedding): vec_id, n_links, component_id, kept."""
    with scratch(table.sparkSession):
        return written(_near_vectors(table), keep=True)


def _near_vectors(table: DataFrame) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_unit, "vec_id long, unit binary, digest long"))
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("vec_id", "unit")).alias("m"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("digest", F.col("m.vec_id").alias("d"), F.col("m.unit").alias("unit"), "copies"))
    # a repeated vec_id with different vectors is more than one class: those are told apart by the digest from here on
    vectors = classes.select(F.col("digest").alias("d"), "unit", "copies")
    n = vectors.count()
    vectors = vectors.withColumn("root", F.col("d"))
    links = roots = None
    for search in range(SEARCHES if n > 1 else 0):
        met = written(_lists(_first_lists(vectors, n, search)))
        near = _found(met)
        links = near if links is None else links.unionAll(near)
        vectors = _placed(vectors, links)
        for _ in range(DESCENTS):
            before = met.filter(f"kind <> {LINK}")
            met = written(_lists(before.unionAll(_descend(before.select("u", "v"), vectors))))
            changed = met.filter(f"kind <> {LINK}").join(before, ["u", "v"], "left_anti").count()
            links = links.unionAll(_found(met))
            if changed < 0.001 * K * n:
                break
        vectors = _placed(vectors, links)
        found = _against_all(vectors, _sample(vectors, search))
        recall = _recall(found)
        log.info("search %s: recall %.5f in the worst stratum of the sample", search, recall)
        links = links.unionAll(_joining(found))
        if recall >= RECALL or n <= SAMPLE:  # a sample of all is exact
            break
    else:
        if n > 1:
            log.warning("recall %.5f after %s searches: all pairs of %s classes are compared", recall, SEARCHES, n)
            links = links.unionAll(_exact(_placed(vectors, links), n))
    if links is not None:
        roots = written(components(links))
        placed = classes.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        counts = _counted(vectors.drop("root"), roots).withColumnRenamed("d", "digest")
        placed = placed.join(counts, "digest", "left")
    else:
        placed = classes.withColumn("root", F.col("digest")).withColumn("n", F.lit(None).cast("long"))
    placed = written(placed.select("digest", "d", "root", "copies", "n"))
    least = placed.groupBy("root").agg(F.min("d").alias("component_id"))
    known = placed.join(least, "root").select("digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = join_hot(rows.select("vec_id", "digest"), known, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id FROM v)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
