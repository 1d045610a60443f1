"""Operator 11, conversation structure repair by a grammar-compressed shortest path.

A conversation's turns should spell `(s?(ua)+)?` by the initials of their roles. Each turn is kept (K, free), gets another role
(R, 2) or is deleted (D, 3, forced for a blank or duplicate turn); empty user or assistant turns are inserted (I, 2). A
truncated turn that stays adds 1. The cheapest edits are found, of equal ones those whose letters sort first.

A turn is one symbol: the initial of its role (s, u, a or another) and its fault. What a stretch of symbols can do is a
min-plus matrix over the four states of the grammar, each entry a cost and an audit rope. Re-Pair replaces frequent pairs of
symbols, in all conversations of a batch at once, by rules; a rule's matrix is the product of its two parts, made once,
bottom-up, and shared by every conversation in which the rule stands. Ropes point to the ropes of their parts, so a rule adds
no copy of an audit. Equal sequences are solved once. Two audits of one stretch and equal cost are never prefixes of each
other, since they hold one letter a turn besides their insertions, so the least rope stays least however it is extended.

Turns go by turn (null first), then role, then MD5 of the text; null roles and texts count as one space; a null conv_id is a
conversation of its own; repeated rows are repeated turns. An empty role has no initial and counts as another. Columns other
than conv_id, turn, role and text are ignored; an empty table gives no rows. Texts of any length stay in the JVM until the
repaired turns are made. report() moves rows without texts; a conversation's rows meet sorted in one task, which streams them
and holds one byte a turn, as the audit is one cell of the result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import scratch, written

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INITIALS, FAULTS = "sua", 4
#: a symbol is FAULTS * initial + fault; faults are none, truncated, and two that force a deletion
_NONE, _CUT, _BLANK, _AGAIN = range(FAULTS)
#: states of the grammar: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: a pair becomes a rule while it stands this often; symbols that are solved together
LEAST, TOGETHER = 4, 200_000

Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


# ---- ropes and matrices


def _joined(a: Rope, b: Rope) -> Rope:
    return b if a == "" else a if b == "" else (a, b)


def letters(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += [x[1], x[0]]
    return "".join(out)


def before(a: Rope, b: Rope) -> bool:
    """Whether a's letters sort before b's; parts that both share at the same place are skipped."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] * (len(x) > n)
            right += [y[n:]] * (len(y) > n)
            continue
        if isinstance(x, str):
            left.append(x)
        else:
            left += [x[1], x[0]]
        if isinstance(y, str):
            right.append(y)
        else:
            right += [y[1], y[0]]
    return not left and bool(right)


def _better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or a[0] == b[0] and before(a[1], b[1])


def _row_times(row: list[tuple[int, Rope] | None], m: Matrix) -> list[tuple[int, Rope] | None]:
    out: list[tuple[int, Rope] | None] = [None] * STATES
    for x, line in zip(row, m, strict=True):
        if x is not None:
            for j, y in enumerate(line):
                if y is not None and (out[j] is None or x[0] + y[0] <= out[j][0]) and _better(z := (x[0] + y[0], _joined(x[1], y[1])), out[j]):
                    out[j] = z
    return out


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [_row_times(row, b) for row in a]


def _inserts() -> Matrix:
    """Inserting empty turns, none or as many as lead to another state."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        state, n = i, 0
        while out[i][state] is None:
            out[i][state] = (INSERT * n, "I" * n)
            state, n = (ASSISTANT if state == USER else USER), n + 1
    return out


def _turn(symbol: int) -> Matrix:
    """One turn, with insertions before it."""
    initial, fault = divmod(symbol, FAULTS)
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        out[i][i] = (DELETE, "D")
        if fault < _BLANK:
            to = ASSISTANT if i == USER else USER
            kept = initial == (2 if to == ASSISTANT else 1)
            cost = TRUNCATED * (fault == _CUT)
            out[i][to] = (cost + KEEP, "K") if kept else (cost + REROLE, "R")
            if initial == 0 and i == START:
                out[i][SYSTEM] = (cost + KEEP, "K")
    return _times(_inserts(), out)


_END = _inserts()


def _solved(parts: list[Matrix]) -> tuple[int, str]:
    row: list[tuple[int, Rope] | None] = [(0, "") if k == START else None for k in range(STATES)]
    for m in parts:
        row = _row_times(row, m)
    row = _row_times(row, _END)
    a, b = row[START], row[ASSISTANT]
    best = a if a is not None and (b is None or _better(a, b)) else b
    return best[0], letters(best[1])


# ---- Re-Pair


def _picked(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs that stand LEAST times or more, most frequent first, those that share no symbol with one before."""
    used, out = set(), []
    for k in np.lexsort((second, first, -n)):
        a, b = int(first[k]), int(second[k])
        if n[k] < LEAST:
            break
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def repaired_grammar(seq: np.ndarray, symbols: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """seq, symbols below `symbols` with -1 between sequences, compressed; rule k makes symbol symbols + k. In each round
    all picked pairs are replaced, left to right without overlaps."""
    rules: list[tuple[int, int]] = []
    while True:
        next_symbol = symbols + len(rules)
        inside = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
        code = seq[inside].astype(np.int64) * next_symbol + seq[inside + 1]
        # of a run of one symbol every second pair counts, and is replaced
        same = seq[inside] == seq[inside + 1]
        begins = same & ~np.r_[False, (code[1:] == code[:-1]) & (inside[1:] == inside[:-1] + 1)]
        place = np.arange(len(inside))
        since = place - np.maximum.accumulate(np.where(begins, place, 0))
        use = ~same | (since % 2 == 0)
        inside, code = inside[use], code[use]
        kinds, which, n = np.unique(code, return_inverse=True, return_counts=True)
        new = _picked(kinds // max(1, next_symbol), kinds % max(1, next_symbol), n)
        if not new:
            return seq, rules
        to = np.full(len(kinds), -1, np.int64)
        to[np.searchsorted(kinds, [a * next_symbol + b for a, b in new])] = next_symbol + np.arange(len(new))
        hit = to[which] >= 0
        seq = seq.copy()
        seq[inside[hit]] = to[which[hit]]
        seq = np.delete(seq, inside[hit] + 1)
        rules += new


def solve(sequences: list[bytes]) -> list[tuple[int, str]]:
    """Cost and audit of each sequence of symbols."""
    unique = list(dict.fromkeys(sequences))
    seq = np.frombuffer(b"".join(s + b"\xff" for s in unique), np.uint8).astype(np.int64)
    seq[seq == 255] = -1
    n = FAULTS * (len(INITIALS) + 1)
    seq, rules = repaired_grammar(seq, n)
    of: list[Matrix] = [_turn(k) for k in range(n)]
    for a, b in rules:
        of.append(_times(of[a], of[b]))
    ends = np.flatnonzero(seq < 0)
    found = {s: _solved([of[k] for k in seq[a:b]]) for s, a, b in zip(unique, np.r_[0, ends[:-1] + 1], ends, strict=True)}
    return [found[s] for s in sequences]


# ---- Spark


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by a hash of conversation and turn: dropped, emptied, stripped of stops, repeated, made user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    df = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), by.alias("_by")).filter("_by <> 0")
    said = F.when(F.col("_by") == 1, "").when(F.col("_by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("_by") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_by") == 3, 2).otherwise(1))).alias("_n"))
    return df.drop("_n")


def _whole(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))


_ORDER = ["conv_id", "turn", "role", "digest"]


def symbols(turns: DataFrame) -> DataFrame:
    """A row without its text for each turn: conv_id, turn, role, digest, initial (s, u, a or empty), symbol."""
    rows = _whole(turns)
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", _BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), _CUT).otherwise(_NONE)
    slim = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    # a duplicate comes after the first of its kind; counts are made before rows move, and only repeated kinds are joined back
    first = slim.groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")).filter("n > 1")
    again = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    joined = slim.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    late = F.coalesce(F.struct(F.col("turn").isNotNull(), "turn") > F.col("first"), F.lit(False))
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select("conv_id", "turn", "role", "digest", (kind * FAULTS + F.when(late & (F.col("fault") != _BLANK), _AGAIN).otherwise(F.col("fault"))).cast("int").alias("symbol"))


REPORT = "rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """Counts of one conversation, fed turn by turn in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.seq, self.last, self.role = conv_id, bytearray(), None, None
        self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, row: tuple, symbol: int) -> None:
        initial, fault = divmod(symbol, FAULTS)
        if row == self.last and fault != _BLANK:  # a repeated row stands right behind its like
            symbol = initial * FAULTS + _AGAIN
        if self.seq:
            self.illegal += (self.role, initial) not in _LEGAL
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.seq.append(symbol)
        self.last, self.role = row, initial

    def report(self) -> tuple:
        n = np.bincount(np.frombuffer(bytes(self.seq), np.uint8) % FAULTS, minlength=FAULTS).tolist()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, len(self.seq), gaps, n[_BLANK], n[_AGAIN], n[_CUT], self.illegal


def _reports(schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Conversation] = []
        held = 0

        def give() -> pa.RecordBatch:
            rows = [(*c.report(), *x) for c, x in zip(done, solve([bytes(c.seq) for c in done]), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        now: _Conversation | None = None
        for batch in batches:
            for conv, turn, role, digest, symbol in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now)
                        held += len(now.seq)
                        if held >= TOGETHER:
                            yield give()
                            held = 0
                    now = _Conversation(conv)
                now.add(turn, (turn, role, digest), symbol)
        if now is not None:
            done.append(now)
            yield give()

    return run


def _arrow(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


def report(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text), integers and strings: conv_id and the columns of REPORT."""
    rows = symbols(turns.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")))
    names = [x.split() for x in REPORT.split(", ")]
    schema = pa.schema([("conv_id", pa.int64()), *[(n, _arrow(k)) for n, k in names]])
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_reports(schema), f"conv_id long, {REPORT}")


REPAIRED = "conv_id long, at long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit comes as its first row; the edits are applied to the turns as they pass."""
    audit, pos, state, at, conv = "", 0, START, 0, None
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal pos, state, at
        while pos < len(audit) and audit[pos] == "I":
            state = ASSISTANT if state == USER else USER
            out.append((conv, at, "I", "assistant" if state == ASSISTANT else "user", ""))
            pos, at = pos + 1, at + 1

    def give() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "at", "edit", "role", "text"])
        out.clear()
        return batch

    for batch in batches:
        for own, found, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if found is not None:
                audit, pos, state, at, conv = found, 0, START, 0, own
            else:
                edit = audit[pos]
                pos += 1
                if edit != "D":
                    if edit == "K" and role[:1] == "s":
                        state = SYSTEM
                    else:
                        state = ASSISTANT if state == USER else USER
                        role = role if edit == "K" else "assistant" if state == ASSISTANT else "user"
                    out.append((conv, at, edit, role, text))
                    at += 1
            inserted()
        yield give()


def repaired(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The turns after the cheapest edits of reports (conv_id, audit), sorted by conv_id and at within partitions: conv_id, at
    (from 0), edit, role, text."""
    rows = _whole(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", "digest", "text")
    heads = reports.select("conv_id", "audit", *[F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))])
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_edited, REPAIRED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, schema = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    now, begun, sha = None, False, hashlib.sha256()
    for batch in batches:
        done = []
        for conv, at, role, text in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
            if not at:
                if begun:
                    done.append((now, sha.hexdigest()))
                now, begun, sha = conv, True, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(role.encode())
            sha.update(b":")
            sha.update(text.encode())
        cols = list(zip(*done, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names)


def digests(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """For each conv_id of conversations the report on its turns and the digest of them repaired; zeros and the digest of
    nothing where it has no turns or none is left."""
    with scratch(turns.sparkSession):
        reports = written(report(turns), keep=True)
    shas = repaired(turns, reports).mapInArrow(_digested, "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    same = lambda other: F.col("id").eqNullSafe(other["conv_id"])
    df = ids.join(reports, same(reports), "left").drop("conv_id").join(shas, same(shas), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return df.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ord(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"
ORACLE = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC} % 20 AS h FROM c),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS initial FROM d),
t AS (SELECT conv_id, r, turn, role, text, initial, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY r) || initial AS pair FROM o),
ins(f, t, cost, letters) AS (VALUES ('-', '-', 0, ''), ('-', 'u', 2, 'I'), ('-', 'a', 4, 'II'), ('s', 's', 0, ''), ('s', 'u', 2, 'I'), ('s', 'a', 4, 'II'), ('u', 'u', 0, ''), ('u', 'a', 2, 'I'), ('a', 'a', 0, ''), ('a', 'u', 2, 'I')),
e AS (SELECT i.f, i.letters || p.edit AS letters, i.cost + p.cost AS cost, p.t, p.initial, p.stays
  FROM ins i JOIN (SELECT s.f, s.t, x.initial, m.edit, m.cost, m.edit <> 'D' AS stays FROM (VALUES ('-', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a'), ('-', 's'), ('-', '-'), ('s', 's'), ('u', 'u'), ('a', 'a')) s(f, t), (VALUES ('s'), ('u'), ('a'), ('-')) x(initial), (VALUES ('K', 0), ('R', 2), ('D', 3)) m(edit, cost)
    WHERE CASE m.edit WHEN 'D' THEN s.f = s.t WHEN 'R' THEN s.f <> s.t AND s.t <> 's' ELSE s.f <> s.t AND s.t = x.initial END) p ON p.f = i.t),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS r, '-' AS state, 0::BIGINT AS cost, '' AS audit FROM t
  UNION ALL SELECT conv_id, r, state, b.cost, b.audit FROM (SELECT dp.conv_id, t.r, e.t AS state, min({{'cost': dp.cost + e.cost + CASE WHEN e.stays AND t.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': dp.audit || e.letters}}) AS b
    FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.r = dp.r + 1 JOIN e ON e.f = dp.state AND e.initial = t.initial AND (NOT e.stays OR t.fault IN ('none', 'truncated')) GROUP BY dp.conv_id, t.r, e.t)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS rows FROM t GROUP BY conv_id),
best AS (SELECT n.conv_id, min({{'cost': dp.cost + ins.cost, 'audit': dp.audit || ins.letters}}) AS b FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.r = n.rows JOIN ins ON ins.f = dp.state AND ins.t IN ('-', 'a') GROUP BY n.conv_id),
l AS (SELECT conv_id, p, b.audit[p] AS edit FROM (SELECT *, unnest(range(1, length(b.audit) + 1)) AS p FROM best)),
m AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS r FROM l),
g AS (SELECT m.conv_id, p, edit, CASE WHEN edit <> 'I' THEN t.role END AS role, CASE WHEN edit <> 'I' THEN t.text ELSE '' END AS text, t.initial, row_number() OVER (PARTITION BY m.conv_id ORDER BY p) AS j FROM m LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.r = m.r WHERE edit <> 'D'),
q AS (SELECT *, max(CASE WHEN j = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM g),
s AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM q GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.b.cost, 0) AS BIGINT) AS cost, coalesce(best.b.audit, '') AS audit, coalesce(s.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""
