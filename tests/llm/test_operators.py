"""Each operator against a brute-force version, on given texts and on awkward ones: nulls, empty and very long texts, ties,
repeated rows, extra columns with clashing names, and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from framelake.llm import bpe, brown, chat, common, decontaminate, importance, jaccard, langid, licenses, substrings, vectors
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (900_001, None, "en"), (900_002, "", "en"), (900_003, " \n\t ", None), (900_004, "12 34 !!", "fr"), (900_005, LONG, "en"), (900_006, LONG, None), (900_007, "a b", "de"), (900_008, "A  b", "de"),
    (900_009, "Released Under the MIT license. under the mit-license; CC BY-NC 4.0\x00 Apache License, Version 2.0", "en"), (900_010, "don't <|endoftext|> x́ É ẞ 漢字 Kelvin", "en"),
    (900_010, "don't <|endoftext|> x́ É ẞ 漢字 Kelvin", "en"), (None, "no id here at all, five words", "en"), (None, None, None), (900_011, "x" * 50_000, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents and odd ones, with columns whose names clash with those the operators make."""
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    df = given.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string"))
    extra = {c: F.lit(1) for c in ("score", "n_words", "row", "key", "d", "unit", "at", "component_id", "labels", "u", "source", "n_chars")}
    return df.withColumns(extra).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def in_order(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_language_id(spark, docs, texts, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(texts)
    truth = {d: lang for d, _, lang in texts if d is not None and d < 900_000}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert all((by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0) for d in (900_001, 900_002, 900_003, 900_004))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_scores_are_a_naive_bayes(spark):
    rows = [(0, "aba ab", "x"), (1, "aab", "x"), (3, "bcb cb", "y")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {k: Counter(int(b) for _, t, lang in rows if lang == k for g in langid._grams(langid._codes(t)) for b in g) for k in "xy"}
    size = 1 << langid.BUCKET_BITS
    for k, n in counts.items():
        for b, c in n.items():
            assert model.weights["xy".index(k)][b] == pytest.approx(math.log((c + 0.5) / (sum(n.values()) + 0.5 * size)))
    np.testing.assert_allclose(np.exp(model.priors), [2 / 3, 1 / 3])


def test_language_predictions_by_brute_force(spark):
    """Each text alone, each n-gram alone; an empty string is a language, ties go to the one that sorts first."""
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("abc " if k % 2 else "bcd ", k=30)), ("", "y")[k % 2]) for k in range(40)] + [(50, "zzz", None), (51, None, "y"), (52, " 1 ", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.names == ["", "y"]
    for r in df.select("text", langid.predict(F.col("text"), model).alias("p")).collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert tuple(r["p"]) == ("und", 0.0)
            continue
        sums = [model.priors[k] + sum(model.weights[k][int(b)] for g in langid._grams(langid._codes(r["text"])) for b in g) for k in (0, 1)]
        best = max((0, 1), key=lambda k: (sums[k], -k))
        assert r["p"]["lang_pred"] == model.names[best]
        assert r["p"]["score"] == pytest.approx(math.exp(sums[best] - max(sums)) / sum(math.exp(x - max(sums)) for x in sums), abs=2e-6)
    assert langid.identify(df).count() == len(rows)


def test_license_base(docs, texts, none):
    got = in_order(licenses.detect(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for d, t, _ in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        want.append((d, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr)
    assert licenses.detect(none).count() == 0


def test_license_rules_and_suppression(spark):
    cases = {
        "SPDX-License-Identifier: GPL-3.0": "gpl-3", "Licensed under the CC BY-NC-SA 4.0 license": "cc-by-nc,cc-by-nc-sa", "licensed under the bsd 3-clause license": "bsd-3-clause",
        "under the mit license": "mit", "apache license, version 2.0 license": "apache-2", "no rule here, only a license": "", "all rights reserved": "proprietary",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.detect(df).collect()}
    assert [got[k][0] for k in range(len(cases))] == list(cases.values())
    assert all(0 <= s <= 1 for _, s in got.values())
    assert len(licenses.rules()) >= 300


def chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 1, "assistant", None), (2, None, None, None), (2, 3, "a\nb", "100%25 %3C| %"), (None, 0, "assistant", "é\n"), (None, 0, "assistant", "é\n"),
        (3, 0, "assistant", ""), (3, 1, "assistant", "x<"), (3, 2, "user<|im_start|>", "<|"), (4, 0, "assistant", "<<|im_end|>"),
    ]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")


def test_chat_round_trip(spark):
    rows, df = chats(spark)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    for r in chat.format_chats(df).collect():
        assert r["formatted"].count("<|im_start|>") == len(r["turns"]) == r["formatted"].count("<|im_end|>")
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_bpe(docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, text, _ in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert in_order(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(none).count() == 0


def test_bpe_joins_are_repaired():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.vocabulary()), bpe.Encoder(bpe.vocabulary())
    rng = random.Random(3)
    alphabet = "ab c\n d'stéÉ́ ,.1漢<|endoftext|>  "
    for _ in range(30):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 700, 4000])))
        (n, ids, _), = bpe.encode_texts([text], e)
        want = t.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == want and n == len(want)
    assert len(bpe.cuts("".join(rng.choice("abcd ") for _ in range(50_000)))) > 20
    shared = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    a, b = "p" * 300 + " " + shared, "q " + shared
    assert {a[i:j] for i, j in bpe.parts(a)} & {b[i:j] for i, j in bpe.parts(b)}


def test_bpe_windows_widen(monkeypatch):
    """Joins that are told to disagree are encoded over more and more of the text, with equal ids."""
    e = bpe.Encoder(bpe.vocabulary())
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh.,'é", k=6)) for _ in range(1500))
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    real, seen = bpe.repaired, []

    def refuse(window, before, after):
        seen.append(1)
        return None if len(seen) % 7 == 3 else real(window, before, after)

    monkeypatch.setattr(bpe, "repaired", refuse)
    (n, ids, _), = bpe.encode_texts([text], e)
    assert [int(x) for x in ids.split()] == want and n == len(want)
    monkeypatch.setattr(bpe, "repaired", lambda *_: None)
    (n, ids, _), = bpe.encode_texts([text], e)
    assert [int(x) for x in ids.split()] == want
    assert real((3, b" 12 3 4", b" a b c"), (1, b" 1", b" a"), None) is None
    assert real((3, b" 12 3 4", b" a b c"), (1, b" 12", b" a"), (1, b" 4", b" c")) == (1, b" 3", b" b")


def duplicates(texts):
    """Shingle sets and components by brute force over rows."""
    sets = []
    for _, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for a, b in {(x, y) for v in holders.values() for x in v for y in v if x < y}:
        k = len(sets[a] & sets[b])
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            parent[find(b)] = find(a)
    least = {}
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i), d)) for i, (d, _, _) in enumerate(texts)]


def test_jaccard_join(spark, docs, texts, none):
    got = in_order(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(duplicates(texts), key=repr)
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_join_of_hot_groups(spark, monkeypatch):
    """Leaders first: a clique of edits of one text, and many texts around a common passage."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LEADERS", 3)
    monkeypatch.setattr(jaccard, "COMMON", 50)
    rng = random.Random(5)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(own), None))
    rows += [(100 + i, " ".join([f"x{i}-{k}" for k in range(rng.randint(0, 14))] + passage), None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert in_order(jaccard.near_duplicates(df), "doc_id", "n_shingles", "component_id") == sorted(duplicates(rows), key=repr)


def test_substrings(docs, texts, none):
    rows = [(d, t) for d, t, _ in texts if d is not None]
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for u in substrings.split_units(t or ""):
            first.setdefault(u[3], d)
    want = set()
    for d, t in rows:
        run = []
        for u in [*substrings.split_units(t or ""), None]:
            if u and (u[4] or first[u[3]] != d):
                run.append(u)
                continue
            if run and sum(x[2] for x in run) >= substrings.MIN_WORDS:
                want.add((d, run[0][0], run[-1][1], first[run[0][3]]))
            run = []
    got = substrings.repeats(docs).filter("doc_id IS NOT NULL").select("doc_id", "start", "end", "first_doc_id")
    assert {tuple(r) for r in got.collect()} == want and want
    out = {(r["doc_id"], r["text"]) for r in substrings.deduplicate(docs).select("doc_id", "text").collect() if r["doc_id"] is not None}
    for d, t in rows:
        for a, b in sorted(((a, b) for i, a, b, _ in want if i == d), reverse=True):
            t = t[:a] + t[b:]
        assert (d, t) in out
    assert substrings.repeats(none).count() == 0 and substrings.deduplicate(none).count() == 0
    assert substrings.deduplicate(docs).columns == docs.columns


def test_units_of_long_runs_of_stops():
    units = list(substrings.split_units("." * 300_000 + " a. " + "? ! " * 1000))
    assert units[0][:2] == (0, 300_001) and len(units) == 2002


def test_units_cover_the_text():
    text = "One two. Three!  \n\nfour five\n six? seven"
    units = list(substrings.split_units(text))
    assert "".join(text[a:b] for a, b, *_ in units).replace("\n", "") == text.replace("\n", "")
    assert [text[a:b].strip() for a, b, *_ in units] == ["One two.", "Three!", "four five", "six?", "seven"]


def greedy(item, doc, m):
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and not a[p + k] and not b[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < m:
            return out
        out.append(best)
        for i in range(k):
            a[p + i] = b[t + i] = True


def test_tiles():
    rng = random.Random(1)
    for _ in range(40):
        item, doc = ([rng.randint(1, 3) for _ in range(rng.randint(0, n))] for n in (20, 50))
        got = decontaminate.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64))
        assert sum(x[2] for x in got) == sum(x[0] for x in greedy(item, doc, max(1, min(len(item), decontaminate.MIN_TILE))))


def test_decontamination(spark, docs, texts, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "two words"), (None, "a b c d e")], "item_id long, text string"))
    items = [(r["item_id"], decontaminate.WORD.findall(r["text"].lower())) for r in bench.collect() if r["text"]]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    want = set()
    for d, t, _ in texts:
        words = decontaminate.WORD.findall((t or "").lower())
        held = set(words)
        for i, item in items:
            if len(held & set(item)) < 0.5 * len(set(item)) or len(words) > 2000:
                continue
            if item and sum(x[0] for x in greedy(item, words, min(len(item), decontaminate.MIN_TILE))) >= 0.5 * len(item):
                want.add((d, i))
    assert {x for x in got if x in want} == want and all(x in want or len(dict((d, t) for d, t, _ in texts)[x[0]].split()) > 1500 for x in got)
    text = " ".join(items[0][1])
    half = len(items[0][1]) // 2
    turned = " ".join(items[0][1][half:] + ["zz"] + items[0][1][:half])
    df = spark.createDataFrame([(1, text), (2, turned), (3, "nothing of it"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(df, bench).filter(F.col("item_id") == items[0][0]).collect()} == {1, 2}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def small_model(monkeypatch):
    for name, value in (("UNITS", 200), ("KNOWN", 500), ("ROUNDS", 3), ("HELD", 20_000)):  # names that only functions sent to tasks read
        monkeypatch.setattr(brown, name, value)


def test_lm_gains_are_exact():
    rng = np.random.default_rng(4)
    n, k = 30, brown.CLASSES
    counts = rng.integers(0, 6, (n, n)).astype(float)
    classes = rng.integers(0, k, n)
    table = lambda c: np.array([[counts[np.ix_(c == a, c == b)].sum() for b in range(k)] for a in range(k)])
    for u in range(8):
        after, before = (np.bincount(classes, x, k) for x in (counts[u], counts[:, u]))
        got = brown.gains(int(classes[u]), after, before, counts[u, u], table(classes))
        for c in rng.integers(0, k, 6):
            moved = classes.copy()
            moved[u] = c
            assert got[c] == pytest.approx(brown.likelihood(table(moved)) - brown.likelihood(table(classes)), abs=1e-6)


def test_lm_score_by_brute_force(spark, docs, texts, monkeypatch):
    """Bigrams and the model's probabilities of each token, one token at a time; the likelihood never falls."""
    small_model(monkeypatch)
    train = docs.filter(common.remainder(F.col("doc_id"), 7) != 2).select("text")
    counts = common.written(brown.count_words(train))
    seen = []
    cluster = brown.cluster
    monkeypatch.setattr(brown, "cluster", lambda b: cluster(b, seen.append))
    m = brown.fit(train, counts)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    n = {r["word"]: r["n"] for r in counts.collect()}
    number = {int(h): k for k, h in enumerate(m.listed)}
    words = lambda t: [brown._memo[w] for w in (t or "").encode().lower().split()]
    own = int((m.seen > max(brown.FEW, brown._frequent(counts, brown.UNITS))).sum())
    unit = lambda h: 0 if h == brown.END else number[h] + 1 if number.get(h, own) < own else brown.UNITS + 1 + h % brown.POOLS
    pairs = Counter()
    for r in train.collect():
        u = [0, *map(unit, words(r["text"])), 0]
        pairs.update(zip(u, u[1:], strict=False))
    got = Counter()
    for r in brown._bigrams(train, m.listed, own).collect():
        for v, k in zip(np.frombuffer(r["after"], np.int32), np.frombuffer(r["n_after"], np.int64), strict=True):
            got[r["unit"], int(v)] += int(k)
        assert np.frombuffer(r["n_before"], np.int64).sum() == sum(k for (_, v), k in pairs.items() if v == r["unit"])
    assert got == pairs
    total = {c: sum(k for h, k in n.items() if h != brown.END and of(m, number, h) == c) for c in range(brown.CLASSES)}
    kinds = Counter(of(m, number, h) for h in n if h != brown.END)
    np.testing.assert_allclose(m.below, [math.log10(total[c] + brown.DELTA * (kinds[c] + 1)) for c in range(brown.CLASSES)])
    np.testing.assert_allclose((10**m.move).sum(1), 1)
    want = []
    for d, t, _ in texts:
        at, s = 0, 0.0
        for h in words(t):
            c = of(m, number, h)
            s += m.move[at, c] + math.log10(n.get(h, 0) + brown.DELTA) - m.below[c]
            at = c
        s += m.move[at, 0]
        want.append((d, s))
    monkeypatch.setattr(brown, "fit", lambda *_: m)
    rows = sorted(((r["doc_id"], r["score"]) for r in brown.score(docs).collect()), key=repr)
    np.testing.assert_allclose([x[1] for x in rows], [x[1] for x in sorted(want, key=repr)], atol=1e-4)


def of(m, number, h):
    return int(m.classes[number[h]]) if h in number else int(m.pools[h % brown.POOLS])


def test_lm_base(docs, texts, none, monkeypatch):
    small_model(monkeypatch)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    part = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    c = Counter(w for d, t, _ in texts if d is not None and part(d) != 2 for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = sorted(((d, part(d) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total) for d, t, _ in texts), key=repr)
    rows = brown.score(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows), key=repr) == want
    base = {d: sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(t)) for d, t, _ in texts}
    assert all(r["base_score"] == pytest.approx(base[r["doc_id"]], abs=1e-4) for r in rows if r["doc_id"] is not None)
    assert all(r["score"] < 0 for r in rows)
    assert brown.score(none).count() == 0


def test_lm_beats_single_words_on_held_out_texts(spark):
    held = brown.score(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).filter("held_out")
    r = held.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert r["model"] / r["n"] > r["base"] / r["n"] + 0.05


def test_importance(spark, docs, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (900_005, None, None)], "doc_id long, quality int, toxic int"))
    rows = importance.resample(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (900_001, 900_002))
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    share = lambda q: np.mean([r["selected"] for r in rows if known.get(r["doc_id"]) == q])
    assert share((1, 0)) > 0.9 > 0.3 > share((0, 0))
    assert importance.resample(none, labels).count() == 0
    assert all(r["selected"] for r in importance.resample(docs, labels.limit(0)).collect())


def test_importance_by_brute_force(spark):
    """Weights one n-gram at a time, and the draw by sorting; labels repeat, clash in their columns and tie."""
    rng = random.Random(9)
    texts = {k: " ".join(rng.choices(["a", "b", "c", "dd"] if k % 2 else ["b", "e", "f"], k=rng.randint(0, 30))) for k in range(60)}
    rows = [(k, 1 if k % 2 else 0, 1 if k % 10 == 1 else 0, "x") for k in range(0, 40)] + [(1, 0, 0, "x"), (3, 1, 0, "y"), (None, 1, 0, "z"), (4, None, 1, "z")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, quality int")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
    known = {k: (max(q for d, q, *_ in rows if d == k and q is not None), max(t for d, q, t, _ in rows if d == k and q is not None)) for k in range(40)}
    good = {k for k, (q, t) in known.items() if q == 1 and t == 0}
    h = lambda w: importance._memo[w]
    mask = (1 << 64) - 1

    def grams(t):
        w = [h(x) for x in t.split()]
        return [x >> 48 for x in w] + [((a * 0x9E3779B97F4A7C15 & mask) ^ (b * 0xC2B2AE3D27D4EB4F & mask)) >> 48 for a, b in zip(w, w[1:], strict=False)]

    raw, target = (Counter(g for k, t in texts.items() if k in keep for g in grams(t)) for keep in (texts, good))
    share = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + importance.BUCKETS))
    got = importance.resample(docs, labels).collect()
    for r in got:
        assert r["log_weight"] == pytest.approx(sum(share(target, g) - share(raw, g) for g in grams(texts[r["doc_id"]])), abs=1e-9)
    k = round(len(good) / len(known) * len(texts))
    assert {r["doc_id"] for r in got if r["selected"]} == {r["doc_id"] for r in sorted(got, key=lambda r: -r["key"])[:k]}


def test_kth_largest(spark):
    values = [random.Random(2).gauss(0, 1) * 10 ** (k % 5) for k in range(30_000)]
    df = common.written(spark.createDataFrame([(v,) for v in values], "x double"))
    for k in (1, 777, 15_000, 30_000):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    near = x[:40] + rng.normal(size=(40, 16)) * 0.1
    clique = x[50] + rng.normal(size=(120, 16)) * 0.01
    real = np.concatenate([x, near, clique])
    rows = [(i, v.tolist()) for i, v in enumerate(real)]
    rows += [(1000, x[3].tolist()), (1001, x[3].tolist()), (1001, x[3].tolist()), (1002, None), (1003, [0.0] * 16), (1004, [float("nan")] * 16), (1005, []), (1006, [None] * 16), (1007, x[3].tolist()[:8]), (1008, (x[3] * 2).tolist()), (1009, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, label int, d int")
    got = in_order(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids = [i for i, _ in good]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(np.triu(links)), strict=True):
        root[find(b)] = find(a)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, int(links[k].sum()), least[find(k)], i == least[find(k)]) for k, i in enumerate(ids)]
    want += [(i, 0, i, True) for i, v in rows if not any(i == j for j in ids)]
    assert got == sorted(want, key=repr)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def links_and_components(x):
    """n_links and component_id of unit vectors by brute force; ids are positions."""
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (new == root).all():
            return list(zip(range(len(x)), near.sum(1).tolist(), root.tolist(), strict=True))
        root = new


def close_groups(pairs, size, hot=0, dim=64):
    """Pairs of tight groups whose cross cosines are about 0.92, and one more group of `hot` vectors."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.normal(size=(pairs, dim)))
    side = rng.normal(size=(pairs, dim))
    b = 0.925 * a + np.sqrt(1 - 0.925**2) * unit(side - (side * a).sum(1, keepdims=True) * a)
    centres = np.concatenate([np.repeat(a, size, 0), np.repeat(b, size, 0), np.repeat(unit(rng.normal(size=(1, dim))), hot, 0)])
    return unit(centres + rng.normal(size=centres.shape) * 0.003)


def test_vectors_of_saturated_groups(spark):
    x = close_groups(200, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == links_and_components(x)


def test_vectors_that_the_search_misses(spark, monkeypatch):
    # one search that meets nobody outside a hot group of a third
    x = close_groups(600, 1, hot=600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    first = vectors._first_lists
    hot = F.xxhash64("unit").isin([r[0] for r in spark.createDataFrame([(bytearray((v / np.abs(v).max() / np.sqrt(((v / np.abs(v).max()) ** 2).sum())).tobytes()),) for v in x[1200:]], "unit binary").select(F.xxhash64("unit")).collect()])
    monkeypatch.setattr(vectors, "SEARCHES", 1)
    monkeypatch.setattr(vectors, "_first_lists", lambda v, n, seed: first(v.filter(hot), n, seed))
    got = vectors.near_vectors(df).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got)) == links_and_components(x)


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_hot_join(spark):
    left = common.written(spark.range(5000).selectExpr("CASE WHEN id < 3000 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k", "id"))
    right = spark.createDataFrame([(7, "hot"), (4001, "cold")], "k long, v string")
    got = Counter(r["v"] for r in common.join_hot(left, right, "k", "left").collect())
    assert got == {"hot": 3000, "cold": 1, None: 1999}
    assert common.join_hot(left, right, "k").count() == 3001
