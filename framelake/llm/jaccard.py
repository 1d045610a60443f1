"""Operator 9, n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds.

The set of a document holds its distinct five-word shingles, as 64-bit hashes. Equal sets form one class, so exact copies
count once. Shingles are ordered by how common they are (a fixed-size sketch, rarest first) and then by hash. Two sets of
sizes m <= n can only reach the threshold when 100 m >= 80 n and when they share a shingle among the first
n - ceil(0.8 n) + 1 of each; only those columns of the incidence matrix are multiplied, a block of columns in each task.

The product counts the columns that two sets share; with what can stand after their prefixes this bounds their overlap,
and pairs below what their sizes ask for are discarded. The sets of the others are multiplied, a block of rows in a task.

A column that more than HOT classes share isn't paired row by row. Each class belongs to the largest column of its prefix,
its home; homes are cut to parts of at most BLOCK sets. In turns the members of a part are multiplied with each other and
with LEADERS random members of the column, and what links is contracted to components. Then parts that meet in a column are
multiplied with each other, but for parts of one component and parts whose sizes can't reach the threshold; a column that
fits a part is multiplied as it is. No link between two components is skipped, and only components are returned.

Texts without words have no shingles and link with nothing. Null and empty texts are such texts. Repeated rows, also with
the same doc_id, are copies; rows without doc_id take part, and a component of such rows only has a null id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import components, join_hot, joined_rows, lean, scratch, written

WORDS, PERCENT = 5, 80
SKETCH = 1 << 22
FILTER = 1 << 23  # bits of the filter on ids before texts are read again
MEMO = 200_000
HOT = 32  # classes of a column from which its sets are multiplied in parts
BLOCK, ELEMENTS = 512, 4_000_000  # sets and shingles in a part, about at most
LEADERS, TURNS = 64, 4
COMMON = 20_000  # documents in a cell of the sketch from which its rows are spread over tasks
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Memo(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_memo = Memo()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8. bytes.lower and bytes.split know exactly A-Z and \\x20 \\x09-\\x0D."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    if not k:
        return h
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * _ODD[i]
        s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(29)))


def _forgetful(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A lean function that also gives up the hashes of words; workers live on and run other operators."""

    def forgetting(batches: Iterator) -> Iterator:
        yield from run(batches)
        _memo.clear()

    return lean(forgetting)


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    texts = batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
    for d, t in zip(batch.column(0).to_pylist(), texts, strict=True):
        yield d, shingles(t.as_py())


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0: id, size, digest), and the sketch's larger counts of this task (kind 1)."""
    names, sketch = ["kind", "a", "n", "d"], np.zeros(SKETCH, dtype=np.int32)
    for batch in batches:
        rows, found = [], [np.zeros(0, np.uint64)]
        for d, s in _sets(batch):
            found.append(s & np.uint64(SKETCH - 1))
            rows.append((d, len(s), digest(s) if len(s) else None))
        np.add.at(sketch, np.concatenate(found).astype(np.int64), np.int32(1))
        a, n, x = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.int64())], names)
    at = np.flatnonzero(sketch >= 6 + 3 * sketch.mean())
    for k in range(0, len(at), 100_000):
        b = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(b), np.int32)), pa.array(b), pa.array(sketch[b].astype(np.int64)), pa.nulls(len(b), pa.int64())], names)


def _columns(docs: DataFrame, survey: DataFrame) -> DataFrame:
    """(shingle, d, n, last): the entries of the columns that bound the join, a row for each class and column. last says how
    far in the order the prefix reaches."""
    got = survey.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter("n >= 64").toPandas()  # at most SKETCH rows
    mean = (survey.filter("kind = 0").agg(F.sum("n")).first()[0] or 0) / SKETCH
    level, heavy = np.zeros(SKETCH, dtype=np.uint8), np.zeros(SKETCH, dtype=bool)
    at, n = got["a"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=float)
    level[at], heavy[at] = np.log2(n).astype(np.uint8), n >= max(COMMON, 8 * mean)
    shared = docs.sparkSession.sparkContext.broadcast((level, heavy))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, heavy), seen = shared.value, set()
        for batch in batches:
            parts = []
            if len(seen) > MEMO:
                seen.clear()
            for _, s in _sets(batch):
                if not len(s) or (x := digest(s)) in seen:
                    continue
                seen.add(x)
                cell = (s & np.uint64(SKETCH - 1)).astype(np.int64)
                order = np.argsort(level[cell], kind="stable")[: prefix_length(len(s))]
                end = order[-1]
                parts.append((s[order].view(np.int64), x, len(s), int(level[cell[end]]) << 25 | int(s[end]) >> 39, heavy[cell[order]]))
            if parts:
                size = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts])),
                        pa.array(np.repeat([p[1] for p in parts], size)),
                        pa.array(np.repeat([p[2] for p in parts], size).astype(np.int32)),
                        pa.array(np.repeat([p[3] for p in parts], size).astype(np.int32)),
                        pa.array(np.concatenate([p[4] for p in parts])),
                    ],
                    ["shingle", "d", "n", "last", "common"],
                )

    rows = docs.mapInArrow(_forgetful(entries), "shingle long, d long, n int, last int, common boolean")
    # columns of a single class go; rows of common cells stay and are spread, so that no group here has over COMMON rows
    w = Window.partitionBy("shingle", "salt")
    rows = rows.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("d"), F.lit(1009))).otherwise(0))
    rows = rows.withColumn("_lo", F.min("d").over(w)).withColumn("_hi", F.max("d").over(w)).filter("common OR _lo <> _hi")
    return rows.select("shingle", "d", "n", "last").distinct()


def _bits(values: DataFrame) -> np.ndarray:
    """The bit filter of values (at), each below FILTER; at most FILTER / 32 rows reach the driver."""
    got = values.groupBy(F.expr("at div 32 AS w")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 32 AS INT))) AS v")).toPandas()
    bits = np.zeros(FILTER // 32, dtype=np.uint32)
    bits[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64).astype(np.uint32)
    return bits


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, s): the sets of the wanted classes (d, doc_id). They stay where they are made: a class may come again, from a copy
    whose id passes the filter too, and a few others come with them."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    shared = docs.sparkSession.sparkContext.broadcast((_bits(wanted.select(bit.alias("at"))), _bits(wanted.select(F.pmod("d", F.lit(FILTER)).alias("at")))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, classes), seen = shared.value, set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((ids[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1))
            if len(seen) > MEMO:
                seen.clear()
            found = {}
            for _, s in _sets(batch):
                if len(s) and (x := digest(s)) not in seen and classes[(k := x % FILTER) // 32] >> np.uint32(k % 32) & 1:
                    found[x] = s.tobytes()
                    seen.add(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["d", "s"])

    return docs.select("doc_id", "text", bit.alias("at")).mapInArrow(_forgetful(chosen), "d long, s binary")


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Shared columns of each pair of rows: the product of two incidence matrices. Columns with few pairs are accumulated
    pair by pair, the others as slices of a dense product."""
    a, b = np.concatenate(one), np.concatenate(two)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two))
    columns = np.intersect1d(a, b)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    if not len(columns):
        return out
    ia, ib = (np.minimum(np.searchsorted(columns, x), len(columns) - 1) for x in (a, b))
    ra, ia = (x[columns[ia] == a] for x in (ra, ia))
    rb, ib = (x[columns[ib] == b] for x in (rb, ib))
    na, nb = (np.bincount(x, minlength=len(columns)) for x in (ia, ib))
    few = na * nb <= 16
    order = np.argsort(ib, kind="stable")
    start = np.cumsum(nb) - nb
    own = few[ia]
    times = nb[ia[own]]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[ia[own]], times)
    code = np.repeat(ra[own], times) * len(two) + rb[order[at]]
    out += np.bincount(code, minlength=out.size).reshape(out.shape)
    number = np.cumsum(~few) - 1
    da, db = ~few[ia], ~few[ib]
    ca, cb, ra, rb = number[ia[da]], number[ib[db]], ra[da], rb[db]
    for k in range(0, int((~few).sum()), 2048):
        x, y = np.zeros((len(one), 2048), np.float32), np.zeros((len(two), 2048), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            here = (c >= k) & (c < k + 2048)
            m[r[here], c[here] - k] = 1
        out += x @ y.T
    return out


def _meeting(size: np.ndarray, near: np.ndarray, first: int, own: bool) -> np.ndarray:
    """The smallest row reachable from each row of a block by near, which holds for the first rows against the rest, and
    against each other if own is set."""
    other = 0 if own else first
    same = np.zeros((len(size), len(size)), dtype=bool)
    same[:first, other:] = near
    return joined_rows(same | same.T)


def _links(ids: list[int], sets: list[np.ndarray], first: int, own: bool) -> list[tuple[int, int]]:
    """Links that join the sets of a block."""
    other = 0 if own else first
    size = np.array([len(s) for s in sets])
    both = overlaps(sets[:first], sets[other:])
    label = _meeting(size, 100 * both >= PERCENT * (size[:first, None] + size[None, other:] - both), first, own)
    return [(ids[k], ids[r]) for k, r in enumerate(label.tolist()) if ids[k] != ids[r]]


def _candidates(blocks: DataFrame, homes: DataFrame) -> DataFrame:
    """blocks (i, j, side, own, d, c, before): the rows of each block that have a candidate of another component c in it, as
    (i, j, side, own, d) with a block for each group of rows that candidates connect. The product of the columns of their
    prefixes counts what two sets share; with what can stand after the prefix that ends first this bounds their overlap.
    before: columns whose blocks hold the row too; two rows that share one of them are tried there."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def give() -> None:
            first = sum(r[0] == 0 for r in rows)
            own = rows[0][1] if rows else False
            other = 0 if own else first
            if not first or len(rows) == other or len(rows) < 2:
                return
            n, last, c = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 6))
            both = overlaps([r[5] for r in rows[:first]], [r[5] for r in rows[other:]])
            x, y = n[:first, None], n[None, other:]
            u, v = last[:first, None], last[None, other:]
            most = both + (PERCENT * np.where(u < v, x, np.where(u > v, y, np.maximum(x, y))) + 99) // 100 - 1
            near = (both > 0) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)) & ((100 + PERCENT) * most >= PERCENT * (x + y))
            near &= c[:first, None] != c[None, other:]
            if near.any() and any(len(r[7]) for r in rows):
                near &= overlaps([r[7] for r in rows[:first]], [r[7] for r in rows[other:]]) == 0
            label = _meeting(n, near, first, own)
            many = np.bincount(label, minlength=len(rows))
            out.extend((*key, int(g), *r[:3]) for g, r in zip(label, rows, strict=True) if many[g] > 1)

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["i", "j", "g", "side", "own", "d"])

        for batch in batches:
            flat, before = batch.column(8), batch.column(9)
            for k, (i, j, side, same, d, n, end, c) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(8)), strict=True)):
                if (i, j) != key:
                    give()
                    key, rows = (i, j), []
                rows.append((side, same, d, n, end, flat[k].values.to_numpy(), c, before[k].values.to_numpy()))
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        give()
        yield batch_of()

    rows = blocks.join(homes.select("d", "n", "last", "columns"), "d").select("i", "j", "side", "own", "d", "n", "last", "c", "columns", "before")
    found = rows.repartition("i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(lean(product), "i long, j long, g long, side int, own boolean, d long")
    return found.select(F.xxhash64("i", "j").alias("i"), F.col("g").alias("j"), "side", "own", "d")


def _multiplied(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """blocks (i, j, side, own, d): links (a, b) found by multiplying the sets of side 0 of each block (i, j) with those of
    side 1, and with each other where own is set."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, held, first, own, out = None, [], [], [], 0, False, []

        def give() -> list[tuple[int, int]]:
            return _links(ids, held, first, own) if first and len(ids) > (0 if own else first) else []

        for batch in batches:
            for i, j, side, same, d, s in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if (i, j) != key:
                    out += give()
                    key, ids, sides, held, first, own = (i, j), [], [], [], 0, same
                if ids and ids[-1] == d and sides[-1] == side:
                    continue  # the set of this class came twice
                ids.append(d)
                sides.append(side)
                held.append(np.frombuffer(s.as_py(), np.uint64))
                first += side == 0
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        out += give()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = blocks.join(sets, "d").select("i", "j", "side", "own", "d", "s")
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", "side", "d").mapInArrow(lean(product), "a long, b long")


def _placed(rows: DataFrame, roots: DataFrame | None, d: str = "d", c: str = "c") -> DataFrame:
    """rows with the component of class d, itself where it has no link. roots (node, root) as components() gives it."""
    if roots is None:
        return rows.withColumn(c, F.col(d))
    return rows.join(roots.select(F.col("node").alias(d), F.col("root").alias("_root")), d, "left").withColumn(c, F.coalesce("_root", d)).drop("_root")


def _contracted(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components of those known and the links found since."""
    known = [] if roots is None else [roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))]
    return written(components(known[0].unionAll(found) if known else found))


def _parts(size: str, elements: str) -> Column:
    return F.ceil(F.greatest(F.expr(size) / BLOCK, F.expr(elements) / ELEMENTS)).cast("int")


def _hot_links(entries: DataFrame, homes: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) of what hot columns join. entries (shingle, d, k) of hot columns; homes (d, n, home, parts, part,
    members, last, columns); fetch gives the whole sets of classes."""

    def tried(blocks: DataFrame) -> DataFrame:
        near = written(_candidates(blocks, homes))
        return written(_multiplied(near, fetch(near.select("d").distinct())))

    roots, none = None, F.array().cast("array<long>")
    several = not homes.filter("parts > 1").isEmpty()
    for turn in range(TURNS if several else 1):
        own = homes
        if turn:
            placed = written(_placed(homes.filter("parts > 1").drop("columns"), roots))
            own = placed.join(placed.groupBy("home").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo <> _hi").select("home"), "home", "left_semi")
        # a share of the column's members, LEADERS at most, goes to each part of its home
        at = own.select("home", "parts", "members").distinct().withColumnRenamed("home", "shingle")
        lead = entries.join(at, "shingle").filter(F.pmod(F.xxhash64("d", "shingle", F.lit(turn)), F.col("k")) < F.least(F.lit(LEADERS), F.expr("2 + members div 8")))
        lead = lead.select(F.col("shingle").alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "d")
        blocks = own.select("home", "part", F.lit(0).alias("side"), "d").unionByName(lead).withColumn("own", F.lit(True))
        blocks = _placed(blocks, roots).select(F.col("home").alias("i"), F.col("part").cast("long").alias("j"), "side", "own", "d", "c", none.alias("before"))
        found = tried(written(blocks) if turn else blocks)  # few rows are left after the first turn, so homes needn't be shuffled
        if turn and found.isEmpty():
            break
        roots = _contracted(roots, found)
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / PERCENT)).cast("int")
    placed = written(_placed(homes.drop("columns"), roots).withColumn("band", band))
    met = entries.join(placed.select("d", "c", "n"), "d")
    mixed = met.groupBy("shingle").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements"), F.bit_xor(F.xxhash64("d")).alias("who")).filter("_lo <> _hi")
    mixed = mixed.groupBy("k", "elements", "who").agg(F.min("shingle").alias("shingle"))  # one of the columns with the same members
    mixed = written(mixed.select("shingle", F.expr(f"k <= {BLOCK} AND elements <= {ELEMENTS}").alias("narrow")))
    if mixed.isEmpty():
        return roots
    # the members of a column that fits a part are multiplied as they are: as many rows as it has entries
    before = F.collect_list("shingle").over(Window.partitionBy("d").orderBy("shingle").rowsBetween(Window.unboundedPreceding, -1))
    narrow = met.join(mixed.filter("narrow").select("shingle"), "shingle", "left_semi").withColumn("before", before)
    blocks = narrow.select(F.col("shingle").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0).alias("side"), F.lit(True).alias("own"), "d", "c", "before")
    wide = mixed.filter("NOT narrow").select("shingle")
    if wide.isEmpty():
        return _contracted(roots, tried(blocks))
    # parts of one component where it is large, and pools of small components
    group = placed.groupBy("home", "band", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"))
    group = group.withColumn("single", F.when(F.col("size") >= BLOCK // 4, F.col("c")))
    sizes = group.groupBy("home", "band", "single").agg(_parts("sum(size)", "sum(elements)").alias("cut"))
    group = group.select("home", "band", "c", "single").join(sizes.withColumnRenamed("single", "_s"), ["home", "band"]).filter("single <=> _s").drop("_s")
    p = F.xxhash64("home", "band", "single", F.when(F.col("single").isNull(), F.pmod(F.xxhash64("c"), F.col("cut"))).otherwise(F.pmod(F.xxhash64("d"), F.col("cut"))))
    placed = written(placed.join(group, ["home", "band", "c"]).withColumn("p", p))
    meet = entries.join(wide, "shingle", "left_semi").join(placed.select("d", "p", "single", "band", "home", "parts"), "d")
    meet = written(meet.select("shingle", "p", "single", "band", "home", "parts").distinct())
    other = meet.select("shingle", F.col("p").alias("q"), F.col("single").alias("single_q"), F.col("band").alias("band_q"), F.col("home").alias("home_q"))
    pairs = meet.join(other, "shingle").filter("p <= q AND abs(band - band_q) <= 1 AND NOT coalesce(single = single_q, false) AND NOT (home = home_q AND parts = 1)")
    pairs = written(pairs.select("p", "q").distinct())
    member = placed.select("d", "c", F.col("p").alias("m"))
    parts = pairs.join(member, F.col("p") == F.col("m")).select("p", "q", F.lit(0).alias("side"), "d", "c").unionByName(pairs.filter("p <> q").join(member, F.col("q") == F.col("m")).select("p", "q", F.lit(1).alias("side"), "d", "c"))
    parts = parts.select(F.col("p").alias("i"), F.col("q").alias("j"), "side", (F.col("p") == F.col("q")).alias("own"), "d", "c", none.alias("before"))
    return _contracted(roots, tried(blocks.unionByName(parts)))


def _classes_joined(docs: DataFrame, survey: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components (node, root) of the classes that verified links connect; None where no column is shared."""
    entries = written(_columns(docs, survey))
    counts = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"))
    hot = written(counts.filter(F.col("k") > HOT))
    some_hot = not hot.isEmpty()
    own = written(entries.groupBy("d").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.collect_list("shingle").alias("columns")))
    hot_entries = written(entries.join(hot, "shingle").select("shingle", "d", "k"))
    homes = hot_entries.groupBy("d").agg(F.max(F.struct("k", "shingle")).alias("h"), F.count(F.lit(1)).alias("h_d")).select("d", F.col("h.shingle").alias("home"), "h_d").join(own, "d")
    sizes = homes.groupBy("home").agg(_parts("count(1)", "sum(n)").alias("parts"), F.count(F.lit(1)).alias("members"))
    homes = written(homes.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int")))
    # the product of the other columns
    cold = entries.join(hot.select("shingle"), "shingle", "left_anti")
    other = cold.select("shingle", F.col("d").alias("b"), F.col("n").alias("m"), F.col("last").alias("last_b"))
    need = f"({PERCENT} * (n + m) + {99 + PERCENT}) div {100 + PERCENT}"
    fits = F.expr(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    pairs = cold.withColumnRenamed("d", "a").join(other, "shingle").filter("a < b").filter(fits)
    pairs = pairs.groupBy("a", "b").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("both"), *(F.first(c).alias(c) for c in ("n", "m", "last", "last_b")))
    # shared columns: those counted and at most the hot ones of either set. After the prefix that ends first come at most so many
    for side in ("a", "b"):
        pairs = pairs.join(homes.select(F.col("d").alias(side), F.col("h_d").alias(f"h_{side}")), side, "left") if some_hot else pairs.withColumn(f"h_{side}", F.lit(0))
    after = f"({PERCENT} * CASE WHEN last < last_b THEN n WHEN last > last_b THEN m ELSE greatest(n, m) END + 99) div 100 - 1"
    pairs = written(pairs.filter(f"both + least(coalesce(h_a, 0), coalesce(h_b, 0)) + {after} >= {need}").select("a", "b", "shingle"))
    sets: list[DataFrame] = []

    def fetch(needed: DataFrame) -> DataFrame:
        if sets:
            needed = needed.join(sets[0].select("d"), "d", "left_anti")
        else:
            needed = needed.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("d"))).distinct()
        needed = written(needed.join(classes.select("d", "doc_id"), "d"))
        if not sets or not needed.isEmpty():
            new = written(_whole_sets(docs, needed))
            sets[:] = [sets[0].unionAll(new) if sets else new]
        return sets[0]

    roots = _hot_links(hot_entries, homes, fetch) if some_hot else None
    apart = written(_placed(_placed(pairs, roots, "a", "ca"), roots, "b", "cb").filter("ca <> cb")) if some_hot else pairs
    if apart.isEmpty():
        return roots
    blocks = apart.select(F.col("shingle").alias("i"), F.explode(F.array("a", "b")).alias("d")).distinct()
    whole = fetch(blocks.select("d").distinct())
    found = written(_multiplied(blocks.select("i", F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), F.lit(True).alias("own"), "d"), whole))
    return _contracted(roots, found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        survey = written(docs.mapInArrow(_forgetful(_survey), "kind int, a long, n long, d long"))
        rows = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), "d")
        classes = written(rows.filter("d is not null").groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
        joined = written(_placed(classes, _classes_joined(docs, survey, classes), "d", "root"))
        least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k"))
        shared = joined.join(least, "root").filter("k > 1 OR copies > 1").select("d", "component_id")
        out = join_hot(rows, shared, "d", "left")
        return written(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), keep=True)


_SPACE = "[ \\t\\n\\v\\f\\r]+"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * k >= {PERCENT} * (n + m - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = s.doc_id), s.doc_id)) AS component_id FROM s
"""
