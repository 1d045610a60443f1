"""Operators 11 to 13 against plain Python on the given tables and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import DATA
from framelake.llm import infill, mixing, queries, scan, structure
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- operator 11


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and least audit by Dijkstra's search; rows of (initial, fault)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, said = heapq.heappop(heap)
        if (k, said) in done:
            continue
        done.add((k, said))
        if k == len(rows) and said in ("", "a"):
            return cost, audit
        new = "a" if said == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", k, new))
        if k < len(rows):
            initial, fault = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, said))
            if fault in ("", "truncated"):
                more = 1 if fault else 0
                heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, new))
                if initial == new or initial == "s" and said == "":
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, initial))
    raise AssertionError


def plain_repair(rows: list[tuple]) -> dict:
    """The report on (conv_id, turn, role, text) as damaged, by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0], r[1], r[2], hashlib.md5(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in got:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, _, _ in got if known]
        initials = [r[2][:1] for r in got]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        texts, k, said = [], 0, ""
        for edit in audit:
            new = "a" if said == "u" else "u"
            role, text = ("user" if new == "u" else "assistant", "") if edit == "I" else got[k][2:]
            k += edit != "I"
            if edit == "D":
                continue
            role = ("user" if new == "u" else "assistant") if edit == "R" else role
            said = "s" if edit == "K" and role[:1] == "s" else new
            texts.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, sha("\n".join(texts)),
        )
    return out


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        by = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        out += [(conv, turn, "user" if by == 4 else role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    return out


def as_rows(df) -> dict:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in names) for r in got}
    assert len(out) == len(got)
    return out


def test_repair_on_the_given_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_repair(plain_damage(given))
    got = as_rows(queries.op11_structure_repair(spark, DATA))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in given}}
    assert sum(r[5] for r in got.values()) > 0


TURNS = "conv_id long, turn long, role string, text string, audit string, n int"
ODD = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, None, "system", "Be."), (1, 7, "user", " \t\n"),
    (2, None, None, None), (2, None, "tool", "x"), (2, 3, "", "y."), (2, 3, "", "y."),
    (None, 1, "assistant", "A."), (None, 2, "assistant", "A."), (None, 3, "user", "no end"),
    (3, 5, "system", "s."), (4, -2, "system", "s."), (4, 0, "system", "t."), (4, 4, "user", "q?"), (4, 5, "ünser", "é."),
    (5, 1, "user", "w " * 200_000 + "."), (5, 2, "assistant", "w " * 200_000),
]


def test_repair_of_odd_rows(spark):
    rnd = random.Random(5)
    long = [(9, t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", "", f"c{t}.", f"d{t}"])) for t in range(1500)]
    many = [(100 + c, t, rnd.choice(["user", "assistant"]), rnd.choice([f"a{t}.", f"b{t}", " "])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows = ODD + long + many
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(5)
    assert as_rows(structure.digests(turns, turns)) == plain_repair(rows)


def test_repaired_turns_follow_the_grammar(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ODD], TURNS)
    got = structure.repaired(turns, structure.report(turns)).collect()
    by = defaultdict(list)
    for r in got:
        assert r["at"] == len(by[r["conv_id"]])
        by[r["conv_id"]].append(r["role"][:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())
    assert 3 not in by and all(r["text"] == "" for r in got if r["edit"] == "I")


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert structure.digests(empty, empty).collect() == []
    ids = spark.createDataFrame([(7,), (None,)], "conv_id long")
    assert as_rows(structure.digests(empty, ids)) == {7: (0, 0, 0, 0, 0, 0, "", sha("")), None: (0, 0, 0, 0, 0, 0, "", sha(""))}


@pytest.mark.parametrize("least", [2, 4, 10**9])
def test_grammar_finds_what_single_turns_find(monkeypatch, least):
    monkeypatch.setattr(structure, "LEAST", least)
    rnd = random.Random(least)
    seqs = [bytes(rnd.choices(range(16), k=rnd.choice([0, 1, 2, 5, 20, 60]))) for _ in range(300)]
    seqs += [bytes([4, 8] * k) for k in range(20)] + [bytes([k]) * 31 for k in range(16)]
    names, faults = "sua-", ["", "truncated", "blank", "duplicate"]
    want = [cheapest([(names[x // 4], faults[x % 4]) for x in s]) for s in seqs]
    assert structure.solve(seqs) == want


def test_rules_spell_the_sequence():
    import numpy as np

    rnd = random.Random(3)
    seq = np.array([rnd.choice([0, 1, 1, 2]) for _ in range(5000)] + [-1] + [3] * 101 + [-1])
    small, rules = structure.repaired_grammar(seq, 16)

    def spelled(x: int) -> list[int]:
        return [x] if x < 16 else spelled(rules[x - 16][0]) + spelled(rules[x - 16][1])

    assert [y for x in small.tolist() for y in spelled(x)] == seq.tolist()
    assert rules and len(small) < len(seq) / 2


# ---- operator 12

DOCS = "doc_id long, text string, source string, size long, target double, k string"


def plain_targets(sizes: dict, weights: list[float], share: float, most: float) -> dict:
    """Targets by rounds, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in held)
        free = [s for s in order if s not in held]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in held else weight[s] * level for s in order}
        held |= above


def held_to_targets(rows: list, docs: list[tuple], share: float = 1.5, weights: tuple = (3, 1, 2)) -> None:
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    want = plain_targets(sizes, list(weights), share, 2.0)
    assert sorted((r["size"] for r in rows)) == sorted(size(t) for _, t, _ in docs)
    source_of = {d: s for d, _, s in docs}
    got: dict = defaultdict(int)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["extra"]
        got[s] += r["taken"]
    for s, t in want.items():
        assert abs(got[s] - t) <= 1


def test_mix_on_the_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = queries.op12_mix_sources(spark, DATA).collect()
    held_to_targets(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op12_mix_sources(spark, DATA).collect()))


def odd_docs() -> list[tuple]:
    rnd = random.Random(2)
    docs = [(k, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([1, 5, 50]))), "hot") for k in range(400)]
    docs += [(1000 + k, rnd.choice([None, "", " \n", "a b\tc", "é"]), rnd.choice(["b", None, "Ω", "", "Z"])) for k in range(200)]
    return [*docs, (5000, "x " * 30_000, "long"), (5001, "y z", "long"), (6000, None, "nothing")]


@pytest.mark.parametrize("small", [True, False])
def test_mix_of_odd_rows(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(mixing, "SMALL", 3)  # the way of many sources
    docs = odd_docs()
    df = spark.createDataFrame([(*d, 1, 2.0, "x") for d in docs], DOCS)
    held_to_targets(mixing.mix(df).collect(), docs)
    held_to_targets(mixing.mix(df, weights=(1,), share=0.3).collect(), docs, 0.3, (1,))


def test_mixture_holds_the_words_taken(spark):
    docs = odd_docs()
    df = spark.createDataFrame([(*d, 1, 2.0, "x") for d in docs], DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    text_of = {d: t for d, t, _ in docs}
    got: dict = defaultdict(int)
    for r in mixing.mixture(df).collect():
        assert (text_of[r["doc_id"]] or "").startswith(r["text"])
        got[r["doc_id"]] += len(r["text"].split())
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if n}


def test_mix_of_repeated_rows_and_of_none(spark):
    rows = [(1, "a b c d", "s")] * 10 + [(2, "e f", "t")] * 3 + [(None, "g", "t")] * 2
    got = mixing.mix(spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], DOCS), share=0.7).collect()
    assert len(got) == 15
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"], r["size"]].add(r["taken"])
    assert all(len(x) == 1 for x in by.values())
    for n, size in ((10, 40), (5, 8)):
        ours = [r for r in got if r["source_size"] == size]
        assert len(ours) == n and -n < sum(r["taken"] for r in ours) - ours[0]["target"] <= 1
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []


# ---- operator 13


def plain_infill(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(params=[1 << 20, 7])
def block(request, monkeypatch):
    """Blocks as they are, and so small that texts lie across many; it holds where functions run in this process."""
    monkeypatch.setattr(scan, "BLOCK", request.param)


def odd_texts() -> list[tuple]:
    rnd = random.Random(4)
    parts = ["a", "bc", " ", "\n", "\t\r", "é", "日本", "<", "P>", "<P", ">", "𝄞", " ", "\x1f", "."]
    texts = ["".join(rnd.choices(parts, k=rnd.choice([0, 1, 2, 6, 40]))) for _ in range(400)]
    texts += [None, "", " ", " x", "x ", "<P>", "a <S> b", "<<M>>", "<P" + ">", "< P>", "x" * 5000]
    return list(enumerate(texts)) + [(None, "a b c d"), (None, None), (-5, "a b c"), (-5, "a b c")]


def test_cut_and_restore_in_blocks(block):
    import pyarrow as pa

    rows = odd_texts()
    texts = pa.array(["x", *[t for _, t in rows]], pa.string())[1:]  # a slice, whose offsets don't begin with 0
    draws = pa.array([bytes.fromhex(sha(f"42:{'' if d is None else d}")) for d, _ in rows])
    made = infill._cut(texts, draws)
    got = [tuple(r.values()) for r in made.to_pylist()]
    assert got == [plain_infill(*r) for r in rows]
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert infill._restored(made.field("output"), made.field("form")).to_pylist() == [t or "" for _, t in rows]


def test_cut_of_no_rows():
    import pyarrow as pa

    assert len(infill._cut(pa.array([], pa.string()), pa.array([], pa.binary()))) == 0
    assert len(infill._restored(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_restoring_a_damaged_output_fails():
    import pyarrow as pa

    with pytest.raises(ValueError, match="marks"):
        infill._restored(pa.array(["<P>a<M>b<S>c"]), pa.array(["psm"]))


def test_infill_of_odd_rows(spark):
    rows = odd_texts() + [(10**6, "word " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, form string")
    got = infill.digests(infill.fill_in_middle(df)).collect()
    want = [(d, *plain_infill(d, t)[:4], sha(plain_infill(d, t)[4]), sha(t or "")) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert infill.digests(infill.fill_in_middle(df.limit(0))).collect() == []


def test_first_words_and_counts(spark, block):
    import pyarrow as pa

    texts = [t for _, t in odd_texts()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert scan._counted(pa.array(texts)).to_pylist() == [len(w) for w in words]
    heads = scan._heads(pa.array(texts), pa.array([3] * len(texts))).to_pylist()
    assert [re.findall(r"[^\x20\x09-\x0D]+", h) for h in heads] == [w[:3] for w in words]
    assert all((t or "").startswith(h) for t, h in zip(texts, heads, strict=True))
    got = spark.createDataFrame([("a b  c", 2), (None, 1), ("x", None)], "t string, k long").select(scan.first_words(F.col("t"), F.col("k")), scan.word_count(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a b", 3), ("", 0), ("", 1)]
