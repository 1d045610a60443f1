"""Texts that repeat themselves and batches of long texts: time and memory stay bounded."""

from __future__ import annotations

import random
import subprocess
import sys
import time

import numpy as np
import pytest
from framelake.llm import decontaminate, langid


def test_one_word_a_million_times_ends_in_seconds():
    item, doc = np.ones(600, np.uint64), np.ones(1_000_000, np.uint64)
    began = time.time()
    assert decontaminate.tiles(item, doc, 300) == [(0, 0, 600)]
    mixed = np.tile(np.arange(1, 4, dtype=np.uint64), 200)
    got = decontaminate.tiles(mixed, np.tile(np.array([3, 1, 2, 9], dtype=np.uint64), 250_000))
    assert got == []
    assert decontaminate.tiles(mixed, np.tile(np.array([2, 3, 1, 2, 3, 9], dtype=np.uint64), 100_000), 10)[0] == (1, 0, 5)
    assert time.time() - began < 20


def brute(item, doc, m):
    """Longest free match first, ties by place in item and then in doc."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and not a[p + k] and not b[t + k]:
                    k += 1
                if k > best[2]:
                    best = (p, t, k)
        p, t, k = best
        if k < m:
            return out
        out.append(best)
        a[p : p + k], b[t : t + k] = [True] * k, [True] * k


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_tiles_in_order(letters):
    rnd = random.Random(letters)
    for _ in range(60):
        item, doc = ([rnd.randint(1, letters) for _ in range(rnd.randint(0, n))] for n in (25, 60))
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64))
        assert got == brute(item, doc, max(1, min(len(item), decontaminate.MIN_TILE)))


def test_too_few_words_in_seeds_make_no_tiles():
    item, doc = np.arange(1, 41, dtype=np.uint64), np.arange(1, 16, dtype=np.uint64)
    assert decontaminate.tiles(item, doc, 20) == [] and decontaminate.tiles(item, doc, 15) == [(0, 0, 15)]


def test_pieces_count_as_the_whole(monkeypatch):
    rnd = random.Random(0)
    texts = ["".join(rnd.choices("ab é.,\n9日", k=n)) for n in (0, 1, 2, 7, 50, 333)] + ["...", "a", "  a", "a  ", "123"]
    whole = [langid._counts(t) for t in texts]
    for t, w in zip(texts, whole, strict=True):
        codes = langid._codes(t)
        assert (w is None) == (len(codes) == 0)
        if w is not None:
            assert w.tolist() == sum(np.bincount(g, minlength=1 << langid.BUCKET_BITS) for g in langid._grams(codes)).tolist()
    for piece in (1, 2, 3, 10):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t, w in zip(texts, whole, strict=True):
            own = langid._counts(t)
            assert (own is None) == (w is None) and (w is None or own.tolist() == w.tolist()), (piece, t)


def test_scores_of_long_texts_equal_those_of_short_ones(monkeypatch):
    rng = np.random.default_rng(1)
    p = np.log(rng.dirichlet(np.ones(1 << langid.BUCKET_BITS), 3))
    model = langid.Model(["a", "b", "c"], p, np.log(np.ones(3) / 3))
    texts = ["some words here", None, "", "99", "more of them, é " * 30, "z"]
    want = langid.scores(texts, model)
    monkeypatch.setattr(langid, "PIECE", 4)
    got = langid.scores(texts, model)
    assert got[0].tolist() == want[0].tolist() and np.allclose(got[1], want[1])
    assert langid.scores(texts, langid.Model([], p[:0], np.zeros(0)))[0].tolist() == ["und"] * 6


def test_a_batch_of_long_texts_stays_small():
    """200 texts of 300,000 letters, one of 20 million: under a gigabyte in a process of its own."""
    code = """
import resource, numpy as np
from framelake.llm import langid
m = langid.Model(list("abcd"), np.log(np.full((4, 1 << langid.BUCKET_BITS), 1e-5)), np.zeros(4))
langid.scores(["abc def " * 37_500] * 200, m)
langid.scores(["abc def " * 2_500_000], m)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=280, check=True, cwd=sys.path[0])
    assert int(out.stdout) < 1000
