"""Operator 10, LM scoring with a Brown class-based bigram model.

A token's probability is P(class | class before) * P(token | class). All training texts are counted whole: token counts, and
bigrams of units. A unit is one of the UNITS most frequent words that were seen over FEW times, one of POOLS pools of the other words, or the end of a text,
so that every bigram counts while their table stays bounded by the square of the number of units; a row of it holds the
neighbours of a unit. Exchange clustering starts from classes dealt by frequency. In each round the exact gain in likelihood
of moving a unit to each class is computed in tasks, one row of the table at a time; the units with a gain move together. A
round is kept only if the likelihood of all bigrams grew, else the strongest quarter of its moves is tried: the likelihood
never falls. Rounds end when it grows by less than LEAST of itself, or after ROUNDS.

The KNOWN most frequent words beyond the units then get the class that makes what stands around them in the training texts
likeliest, and class bigrams are counted again with these classes. Words beyond KNOWN, and those
seen at most FEW times, share the classes of their pools, as words do that were never seen.

Words are compared by 64-bit hashes. Tasks know the counts of the KNOWN most frequent words; other words of a text are kept
with its row and joined with the table of all counts. Class bigrams are smoothed by PRIOR times the classes' own shares,
words by DELTA each, with one unseen word in each class.

A null text counts as empty: one token, the end. The text before the first word is an end. Rows without doc_id are scored
and never learned from. Repeated rows are scored each. With no training text all counts are 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import remainder, scratch, written

UNITS, POOLS, CLASSES = 1 << 14, 1 << 9, 64
KNOWN = 1 << 20
FEW = 2  # words seen no more often have no class of their own
ROUNDS, LEAST = 8, 0.0005
ALPHA, DELTA, PRIOR = 0.1, 0.5, 300.0
MEMO, PIECE, HELD = 500_000, 1_000_000, 4_000_000
END = xxhash.xxh64_intdigest(b" ") - (1 << 63)  # no word holds a space
_SPREAD = 12  # bits of a neighbour's number that share a row before rows are merged


class Memo(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h


_memo = Memo()


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about PIECE tokens: place of the first, hashes of all tokens with an end after each text, and where the
    texts start. bytes.lower and bytes.split know exactly A-Z and \\x20 \\x09-\\x0D."""
    texts = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    first, held, start = 0, [], [0]
    for k, t in enumerate(texts):
        words = t.as_py().lower().split() if t.is_valid else []
        h = np.empty(len(words) + 1, dtype=np.int64)
        h[:-1] = np.fromiter(map(_memo.__getitem__, words), np.int64, len(words))
        h[-1] = END
        held.append(h)
        start.append(start[-1] + len(h))
        if start[-1] > PIECE:
            yield first, np.concatenate(held), np.array(start[:-1])
            first, held, start = k + 1, [], [0]
    if held:
        yield first, np.concatenate(held), np.array(start[:-1])


class Vocabulary:
    """Numbers of words by hash, -1 for all others. A slot table answers for most tokens, a sorted list for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.slots = np.full(1 << 22, -1, dtype=np.int32)
        self.slots[self._slot(keys)[::-1]] = np.arange(len(keys))[::-1]  # of words that share a slot the most frequent

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> 42) & ((1 << 22) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = self.slots[self._slot(h)].astype(np.int64)
        rest = np.flatnonzero((found >= 0) & (self.keys[found] != h)) if len(self.keys) else found[:0]
        at = np.minimum(np.searchsorted(self.sorted, h[rest]), max(0, len(self.keys) - 1))
        found[rest] = np.where(self.sorted[at] == h[rest], self.order[at], -1) if len(rest) else -1
        return found


def pool(h: np.ndarray) -> np.ndarray:
    return (h & (POOLS - 1)).astype(np.int64)


def _summed(code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(code or [np.zeros(0, np.int64)]), return_counts=True)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens, ends included; a word is its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for _, h, _ in pieces(batch.column(0)):
                held.append(h)
                total += len(h)
                if total > HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["word", "n"])
                    held, total = [], 0
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(held))), ["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """A count so that at most `most` words have more; found from counts in steps of a sixteenth of an octave."""
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.filter(F.col("word") != END).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"))
    total = 0
    for s, k, top in sorted(bins.collect(), reverse=True):  # a row for each step
        if (total := total + k) > most:
            return top
    return 0


def _binary(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """A binary column whose rows are the runs of values from each start to the next one."""
    offsets = (np.append(start, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, and how many each row has."""
    width = np.dtype(kind).itemsize
    at = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], kind, int(at[-1] - at[0]) // width, int(at[0])), np.diff(at) // width


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _packed(unit: np.ndarray, other: np.ndarray, n: np.ndarray, side: int) -> pa.RecordBatch:
    """A row for each unit and part of its neighbours, from triples in order of unit and part."""
    at = _starts((unit << 32) | (other >> _SPREAD))
    columns = [pa.array(unit[at].astype(np.int32)), pa.array(np.full(len(at), side, np.int32)), pa.array((other[at] >> _SPREAD).astype(np.int32)), _binary(other.astype(np.int32), at), _binary(n.astype(np.int64), at)]
    return pa.RecordBatch.from_arrays(columns, ["unit", "side", "part", "other", "n"])


_ROWS = "unit int, side int, part int, other binary, n binary"


def _bigrams(docs: DataFrame, listed: np.ndarray, own: int) -> DataFrame:
    """(unit, after, n_after, before, n_before): all neighbours of each unit with counts, a row for each unit. Unit 0 is the end,
    words come next and pools after UNITS words."""
    shared = docs.sparkSession.sparkContext.broadcast(listed[:own])
    size = UNITS + POOLS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = Vocabulary(shared.value), [], 0

        def give() -> pa.RecordBatch:
            code, n = _summed(held)
            return _packed(code // size, code % size, n, 0)

        for batch in batches:
            for _, h, _ in pieces(batch.column(0)):
                k = number(h)
                u = np.where(k >= 0, k + 1, UNITS + 1 + pool(h))
                u[h == END] = 0
                held.append(np.append(0, u[:-1]) * size + u)
                total += len(h)
                if total > 2 * HELD:
                    yield give()
                    held, total = [], 0
        yield give()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows of one unit and part, given in order; and the same counts with the units turned round."""
        codes, counts, total = [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            code, at = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts or [np.zeros(0, np.int64)]), len(code)).astype(np.int64)
            u, v = code // size, code % size
            yield _packed(u, v, n, 0)
            turned = np.lexsort((u, v))
            yield _packed(v[turned], u[turned], n[turned], 1)

        for batch in batches:
            v, many = _flat(batch.column(3), np.int32)
            codes.append(np.repeat(batch.column(0).to_numpy().astype(np.int64), many) * size + v)
            counts.append(_flat(batch.column(4), np.int64)[0])
            total += len(v)
            if total > HELD:
                yield from give()
                codes, counts, total = [], [], 0
        yield from give()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a unit, given in order, as one."""
        rest = np.zeros((2, 0), np.int64)

        def give(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            code, at = np.unique(code, return_inverse=True)
            n = np.bincount(at, n, len(code)).astype(np.int64)
            unit, after = code // (2 * size), code // size % 2 == 0
            kinds, columns = np.unique(unit), []
            for side in (after, ~after):
                at = np.searchsorted(unit[side], kinds)
                columns += [_binary((code[side] % size).astype(np.int32), at), _binary(n[side], at)]
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), *columns], ["unit", "after", "n_after", "before", "n_before"])

        for batch in batches:
            v, many = _flat(batch.column(3), np.int32)
            if not len(v):
                continue
            head = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            rest = np.concatenate([rest, [np.repeat(head, many) * size + v, _flat(batch.column(4), np.int64)[0]]], axis=1)
            done = rest[0] // (2 * size) != rest[0, -1] // (2 * size)  # the last unit may go on in the next batch
            if done.sum() > HELD // 8:
                yield give(*rest[:, done])
                rest = rest[:, ~done]
        yield give(*rest)

    rows = docs.select("text").mapInArrow(count, _ROWS)
    rows = rows.repartition("unit", "part").sortWithinPartitions("unit", "part").mapInArrow(merge, _ROWS)
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(whole, "unit int, after binary, n_after binary, before binary, n_before binary")


def _cells(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a batch, how often each class follows and precedes each of them, and how often a unit follows itself."""
    unit = batch.column(0).to_numpy().astype(np.int64)
    out = [unit]
    for k in (1, 3):
        v, many = _flat(batch.column(k), np.int32)
        n = _flat(batch.column(k + 1), np.int64)[0]
        row = np.repeat(np.arange(len(unit)), many)
        out.append(np.bincount(row * CLASSES + classes[v], n, len(unit) * CLASSES).reshape(-1, CLASSES))
        if k == 1:
            same = np.bincount(row, n * (unit[row] == v), len(unit))
    return (*out, same)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Of all bigrams, but for a part that doesn't depend on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def gains(own: int, after: np.ndarray, before: np.ndarray, same: float, table: np.ndarray) -> np.ndarray:
    """What the likelihood gains when one unit moves from its class to each class. after and before count the classes of
    its neighbours, itself included `same` times."""
    t = table.copy()
    t[own] -= after
    t[:, own] -= before
    t[own, own] += same
    after, before = after.copy(), before.copy()
    after[own] -= same
    before[own] -= same
    rows, columns = table.sum(1), table.sum(0)
    n_after, n_before = after.sum() + same, before.sum() + same
    rows[own] -= n_after
    columns[own] -= n_before
    was = _xlogx(t)
    new = (_xlogx(t + after) - was).sum(1) + (_xlogx(t + before[:, None]) - was).sum(0)
    d = np.diagonal(t)
    # the cell of a class with itself gets both and the unit's own bigrams
    new += _xlogx(d + after + before + same) - _xlogx(d + after) - _xlogx(d + before) + np.diagonal(was)
    new -= _xlogx(rows + n_after) - _xlogx(rows) + _xlogx(columns + n_before) - _xlogx(columns)
    return new - new[own]


def _table(bigrams: DataFrame, classes: np.ndarray, words_only: bool = False) -> np.ndarray:
    """Class bigrams; with words_only those between units that aren't pools."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            unit = batch.column(0).to_numpy().astype(np.int64)
            v, many = _flat(batch.column(1), np.int32)
            n, u = _flat(batch.column(2), np.int64)[0], np.repeat(unit, many)
            if words_only:
                n = n * ((u <= UNITS) & (v <= UNITS))
            sums += np.bincount(classes[u] * CLASSES + classes[v], n, CLASSES * CLASSES)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], ["cell", "n"])

    rows = bigrams.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n"))
    table = np.zeros(CLASSES * CLASSES)
    for cell, n in rows.collect():  # a row for each class pair
        table[cell] = n
    return table.reshape(CLASSES, CLASSES)


def _moves(bigrams: DataFrame, classes: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
    """(unit, class) of every second unit that gains by moving, the largest gain first; at most a row for each unit."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for u, after, before, same in zip(*_cells(batch, classes), strict=True):
                if u and u % 2 == turn % 2:
                    gain = gains(int(classes[u]), after, before, same, table)
                    gain[0] = 0  # the end keeps a class of its own
                    if gain.max() > 1e-6:
                        got.append((int(u), int(gain.argmax()), float(gain.max())))
            kinds = [pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], ["unit", "c", "gain"])

    found = sorted(bigrams.mapInArrow(choose, "unit int, c int, gain double").collect(), key=lambda r: (-r["gain"], r["unit"]))
    return np.array([(r["unit"], r["c"]) for r in found], dtype=np.int64).reshape(-1, 2)


def cluster(bigrams: DataFrame, seen: Callable[[float], None] = lambda x: None) -> np.ndarray:
    """The class of each unit, by exchange. seen gets the likelihood after each round."""
    classes = np.concatenate([[0], 1 + np.arange(UNITS + POOLS) % (CLASSES - 1)])
    table = _table(bigrams, classes)
    now = likelihood(table)
    for turn in range(ROUNDS):
        before, moves = now, _moves(bigrams, classes, table, turn)
        while len(moves):
            trial = classes.copy()
            trial[moves[:, 0]] = moves[:, 1]
            new = _table(bigrams, trial)
            if (value := likelihood(new)) > now:
                classes, table, now = trial, new, value
                break
            moves = moves[: len(moves) // 4]
        seen(now)
        if now - before <= LEAST * abs(now):
            break
    return classes


def _others(docs: DataFrame, listed: np.ndarray, own: int, many: int, classes: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all listed words, and class bigrams counted with them. Each of the first `many` words that isn't a unit takes the class that is
    likeliest given the classes around it; bigrams of words beyond the list go by their pools. sizes: words in each class."""
    shared = docs.sparkSession.sparkContext.broadcast((listed, classes))
    known, none = len(listed), CLASSES
    follow = np.log((table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * CLASSES))
    weight = np.log(sizes + DELTA)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, cells): codes of the class before and the class after, or `none` where the word after counts it itself."""
        listed, classes = shared.value
        number, held, total = Vocabulary(listed), [], 0

        def give() -> pa.RecordBatch:
            code = np.sort(np.concatenate(held or [np.zeros(0, np.int64)]))
            word, cell = code >> 16, (code & 0xFFFF).astype(np.uint16)
            at = _starts(word)
            return pa.RecordBatch.from_arrays([pa.array(word[at].astype(np.int32)), _binary(cell, at)], ["word", "cells"])

        for batch in batches:
            for _, h, _ in pieces(batch.column(0)):
                k = number(h)
                end, unit = h == END, (k >= 0) & (k < own)
                c = classes[np.where(unit, k + 1, UNITS + 1 + pool(h))]
                c[end] = 0
                word = np.where((k >= own) & (k < many), k, known + pool(h))
                at = np.flatnonzero(~(unit | end))
                after = np.where((unit | end)[np.minimum(at + 1, len(h) - 1)], c[np.minimum(at + 1, len(h) - 1)], none)
                held.append(word[at] << 16 | np.append(0, c[:-1])[at] << 8 | after)
                total += len(at)
                if total > HELD:
                    yield give()
                    held, total = [], 0
        yield give()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, class) from all rows of a word, given in order; then class bigrams as (-1 - cell, n)."""
        sums, last, rest = np.zeros((CLASSES, CLASSES)), -1, np.zeros(0, np.int64)

        def give(word: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            kinds, row = np.unique(word, return_inverse=True)
            before, after = code >> 8, code & 0xFF
            lead = np.bincount(row * CLASSES + before, minlength=len(kinds) * CLASSES).reshape(-1, CLASSES)
            tail = np.bincount(row * (CLASSES + 1) + after, minlength=len(kinds) * (CLASSES + 1)).reshape(-1, CLASSES + 1)
            gain = lead @ follow + tail[:, :CLASSES] @ follow.T - lead.sum(1, keepdims=True) * weight
            gain[:, 0] = -np.inf
            best = np.where(kinds < known, gain.argmax(1), classes[UNITS + 1 + np.maximum(kinds - known, 0)])
            np.add.at(sums.T, best, lead)
            np.add.at(sums, best, tail[:, :CLASSES])
            inside = kinds < known
            return pa.RecordBatch.from_arrays([pa.array(kinds[inside].astype(np.int32)), pa.array(best[inside].astype(np.int64))], ["word", "c"])

        for batch in batches:
            cells, many = _flat(batch.column(1), np.uint16)
            if not len(many):
                continue
            word, code = np.repeat(batch.column(0).to_numpy().astype(np.int64), many), cells.astype(np.int64)
            word, code = np.concatenate([np.full(len(rest), last), word]), np.concatenate([rest, code])
            last = int(word[-1])
            done = word != last  # the last word may go on in the next batch
            rest = code[~done]
            if done.any():
                yield give(word[done], code[done])
        if len(rest):
            yield give(np.full(len(rest), last), rest)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - at).astype(np.int32)), pa.array(flat[at].astype(np.int64))], ["word", "c"])

    rows = docs.select("text").mapInArrow(around, "word int, cells binary")
    found = rows.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word int, c long")
    got = found.groupBy("word").agg(F.sum("c").alias("c")).toArrow()  # a row for each listed word and class pair
    word, c = got.column(0).to_numpy(), got.column(1).to_numpy()
    of_word = np.concatenate([classes[1 : own + 1], classes[UNITS + 1 + pool(listed[own:])]])
    of_word[word[word >= 0]] = c[word >= 0]
    more = np.zeros(CLASSES * CLASSES)
    more[-1 - word[word < 0]] = c[word < 0]
    return of_word, more.reshape(CLASSES, CLASSES)


@dataclass
class Model:
    """What is learned of the training texts. Arrays of listed words go by frequency; move and below are log10."""

    listed: np.ndarray
    seen: np.ndarray
    classes: np.ndarray
    pools: np.ndarray
    move: np.ndarray
    below: np.ndarray
    total: int
    kinds: int
    ends: int
    cut: int


def fit(train: DataFrame, counts: DataFrame) -> Model:
    """counts: count_words(train), as a written table."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = {k: _frequent(counts, k) for k in (UNITS, KNOWN)}
    words = counts.filter((F.col("n") > cut[KNOWN]) & (F.col("word") != END)).select("word", "n").toArrow()  # at most KNOWN rows
    listed, seen = words.column(0).to_numpy(), words.column(1).to_numpy()
    order = np.lexsort((listed, -seen))
    listed, seen = listed[order], seen[order]
    own, many = (int((seen > max(FEW, x)).sum()) for x in (cut[UNITS], 0))
    bigrams = written(_bigrams(train, listed, own))
    classes = cluster(bigrams)
    pools = classes[UNITS + 1 :]
    sizes = np.bincount(classes[1 : own + 1], seen[:own], CLASSES)
    of_word, more = _others(train, listed, own, many, classes, _table(bigrams, classes), sizes)
    table = _table(bigrams, classes, words_only=True) + more
    # words and distinct words of each class
    kinds_in, words_in = np.bincount(of_word, minlength=CLASSES).astype(float), np.bincount(of_word, seen, CLASSES)
    pooled = counts.filter((F.col("n") <= cut[KNOWN]) & (F.col("word") != END)).groupBy(F.col("word").bitwiseAND(POOLS - 1).cast("int").alias("p"))
    for p, k, n in pooled.agg(F.count(F.lit(1)), F.sum("n")).collect():  # a row for each pool
        kinds_in[pools[p]] += k
        words_in[pools[p]] += n
    alone = (table.sum(0) + ALPHA) / (table.sum() + ALPHA * CLASSES)
    move = np.log10((table + PRIOR * alone) / (table.sum(1, keepdims=True) + PRIOR))
    return Model(listed, seen, of_word, pools, move, np.log10(words_in + DELTA * (kinds_in + 1)), total, kinds, ends, cut[KNOWN])


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, word array<long>, c array<int>"


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    part = remainder(F.col("doc_id"), 7)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    train = docs.filter(part != 2)
    with scratch(spark):
        counts = written(count_words(train))
        model = fit(train, counts)
        shared = spark.sparkContext.broadcast(model)
        base = float(np.log10(model.total + model.kinds + 1))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, number = shared.value, Vocabulary(shared.value.listed)
            row = TaskContext.get().partitionId() << 40  # numbers of rows; the table is written once
            base_of = np.append(np.log10(m.seen + 1.0) - base, 0.0)
            emit_of = np.append(np.log10(m.seen + DELTA) - m.below[m.classes], 0.0)
            class_of = np.append(m.classes, 0)
            for batch in batches:
                for first, h, start in pieces(batch.column(2)):
                    k = number(h)
                    end, size = h == END, np.diff(np.append(start, len(h)))
                    other = (k < 0) & ~end
                    c = np.where(other, m.pools[pool(h)], class_of[k])
                    c[end] = 0
                    values = np.where(end, np.log10(m.ends + 1.0) - base, base_of[k])
                    place = m.move[np.append(0, c[:-1]), c] + np.where(end, 0.0, emit_of[k])
                    known = (k >= 0) | (end & (m.ends > 0))
                    at = np.flatnonzero(other)
                    offsets = pa.array(np.searchsorted(at, np.append(start, len(h))).astype(np.int32))
                    part = batch.slice(first, len(start))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row + np.arange(len(start))), part.column(0), part.column(1), pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), start)), pa.array(np.add.reduceat(values, start)), pa.array(np.add.reduceat(place, start)),
                            pa.ListArray.from_arrays(offsets, pa.array(h[at])), pa.ListArray.from_arrays(offsets, pa.array(c[at].astype(np.int32))),
                        ],
                        ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word", "c"],
                    )
                    row += len(start)

        found = written(rows.mapInArrow(scored, _SCORED))
        below = F.element_at(F.array(*[F.lit(float(x)) for x in model.below]), F.col("c") + 1)
        rare = counts.filter((F.col("n") <= model.cut) & (F.col("word") != END)).withColumnRenamed("n", "seen")
        words = found.filter("size(word) > 0").select("row", F.explode(F.arrays_zip("word", "c")).alias("w")).select("row", "w.word", "w.c")
        seen = F.coalesce("seen", F.lit(0))
        sums = words.join(rare, "word", "left").groupBy("row").agg(
            F.count_if(seen > 0).alias("k"), F.sum(F.log10(seen + 1) - base).alias("b"), F.sum(F.log10(seen + F.lit(DELTA)) - below).alias("s")
        )
        out = found.drop("word", "c").join(sums, "row", "left")
        score = F.round(F.col("model") + F.coalesce("s", F.lit(0.0)), 6)
        out = out.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
            F.round(F.col("base") + F.coalesce("b", F.lit(0.0)), 6).alias("base_score"), score.alias("score"), F.round(F.pow(F.lit(10.0), -score / F.col("n_tokens")), 6).alias("perplexity"),
        )
        return written(out, keep=True)
