"""Operator 8, benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, lower-cased. Karp-Rabin hashes of MIN_TILE words find where a document
and a benchmark item share a seed. For each such pair the longest match of unmarked words is marked as a tile again and
again, by Karp-Rabin over what is still free, until no match of MIN_TILE words is left. Tiles may stand in any order, so
reordered passages count. A document is contaminated by an item whose words are covered to at least COVERAGE.

Items go to the tasks in blocks of at most about BLOCK_WORDS words; a larger benchmark takes more blocks, not larger ones.
An item of fewer than MIN_TILE words is found only as a whole; items without words, null items and null texts match nothing. Repeated rows give repeated results."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import release

MIN_TILE, COVERAGE = 5, 0.5
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"\w+")
HIT = "array<struct<item_id:bigint,coverage:double,n_tiles:int,covered_words:int,item_words:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Windows:
    """Karp-Rabin hashes of word numbers, for windows of any length at once: sums of words times powers of an odd number,
    brought back to the first power by its inverse, all modulo 2^64."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.back = np.full(len(ids) + 1, _INVERSE, dtype=np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        power = np.full(max(1, len(ids)), _BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * power[: len(ids)], dtype=np.uint64)])

    def of(self, m: int) -> np.ndarray:
        n = max(0, len(self.ids) - m + 1)
        return (self.sums[m : m + n] - self.sums[:n]) * self.back[:n]


def rolling(ids: np.ndarray, m: int = MIN_TILE) -> np.ndarray:
    """Karp-Rabin hashes of all windows of m word numbers."""
    return Windows(ids).of(m)


def _whole(free: np.ndarray, m: int) -> np.ndarray:
    """Whether all m places from each on are free."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return taken[m:] == taken[: max(0, len(taken) - m)]


def _longest(item: Windows, doc: Windows, free: np.ndarray, open_: np.ndarray, least: int, most: int) -> tuple[int, int, int] | None:
    """(place in item, place in doc, length) of the longest match of free places, at least and at most so long. The length is
    found by halving, since a match of any length holds shorter ones; equal hashes are compared word by word."""

    def match(m: int) -> tuple[int, int, int] | None:
        own, other = np.flatnonzero(_whole(free, m)), np.flatnonzero(_whole(open_, m))
        if not len(own) or not len(other):
            return None
        a, b = item.of(m)[own], doc.of(m)[other]
        for p, h in zip(own[(hit := np.isin(a, b))].tolist(), a[hit], strict=True):
            for t in other[b == h].tolist():
                if (item.ids[p : p + m] == doc.ids[t : t + m]).all():
                    return p, t, m
        return None

    best = match(least)
    low, high = least, most
    while best and low < high:
        m = (low + high + 1) // 2
        if got := match(m):
            best, low = got, m
        else:
            high = m - 1
    return best


def tiles(item: np.ndarray, doc: np.ndarray, least: int = 0) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles, longest first; ties by place in item, then doc. An item shorter
    than MIN_TILE is a tile as a whole. None if fewer than `least` words of the item stand in any seed.

    Karp-Rabin runs anew for each tile over the places that are still free, so a repeated seed makes no list of pairs: time
    is the number of tiles times the length of the item and of those parts of the document that hold seeds."""
    if not (m := min(MIN_TILE, len(item))):
        return []
    own = Windows(item)
    a, b = own.of(m), rolling(doc, m)
    seeds = lambda hit, n: np.cumsum(np.bincount(np.flatnonzero(hit), minlength=n + 1)[:n] - np.bincount(np.flatnonzero(hit) + m, minlength=n + 1)[:n]) > 0
    in_item, in_doc = seeds(np.isin(a, b), len(item)), seeds(np.isin(b, a), len(doc))
    if in_item.sum() < max(1, least):
        return []
    # the parts of the document with seeds, one after the other, each followed by a place that is never free
    place = np.flatnonzero(in_doc | np.concatenate([[False], in_doc[:-1]]))
    open_ = in_doc[place]
    part, free, out = Windows(doc[place]), in_item.copy(), []
    longest = len(item)
    while found := _longest(own, part, free, open_, m, longest):
        p, t, longest = found
        free[p : p + longest] = open_[t : t + longest] = False
        out.append((p, int(place[t]), longest))
    return out


def _hits(items: list[tuple[int, list[str]]], text: Column) -> Column:
    vocabulary: dict[str, int] = {}
    numbered = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.uint64)) for i, words in items]
    by_length = {}  # seeds of items by the length of a seed, which is that of the item where this is shorter than MIN_TILE
    for m in range(1, MIN_TILE + 1):
        some = [k for k, (_, x) in enumerate(numbered) if min(MIN_TILE, len(x)) == m]
        if some:
            seeds = np.concatenate([rolling(numbered[k][1], m) for k in some])
            owner = np.repeat(some, [len(numbered[k][1]) - m + 1 for k in some])
            order = np.lexsort((owner, seeds))
            seeds, owner = seeds[order], owner[order]
            once = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])])  # a seed names an item once
            by_length[m] = seeds[once], owner[once], np.unique(seeds)

    @F.pandas_udf(HIT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = vocabulary.get
        for texts in batches:
            out = []
            for text in texts:
                doc = np.array([number(w, 0) for w in WORD.findall(text.lower())], dtype=np.uint64) if text else np.zeros(0, np.uint64)
                hits, owners = [], set()
                for m, (seeds, owner, known) in by_length.items():
                    windows = rolling(doc, m)
                    if not len(windows):
                        continue
                    windows = np.unique(windows[np.convolve(doc == 0, np.ones(m, int), "valid") == 0])
                    windows = windows[known[np.minimum(np.searchsorted(known, windows), len(known) - 1)] == windows]
                    lo, hi = np.searchsorted(seeds, windows, "left"), np.searchsorted(seeds, windows, "right")
                    owners.update(int(owner[x]) for a, b in zip(lo, hi, strict=True) for x in range(a, b))
                if owners:
                    for k in sorted(owners):
                        i, item = numbered[k]
                        got = tiles(item, doc, math.ceil(COVERAGE * len(item)))
                        covered = sum(x[2] for x in got)
                        if covered >= COVERAGE * len(item):
                            hits.append({"item_id": i, "coverage": round(covered / len(item), 6), "n_tiles": len(got), "covered_words": covered, "item_words": len(item)})
                out.append(hits)
            yield pd.Series(out)
        release()

    return found(text)


def contamination(text: Column, benchmark: DataFrame) -> Column:
    """The items (item_id, text) of benchmark that contaminate a text, as an array of structs."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (4 * BLOCK_WORDS)))
    found = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()  # one block
        found.append(_hits([(r["item_id"], WORD.findall(r["text"].lower())) for r in rows], text))
    return found[0] if len(found) == 1 else F.concat(*found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text): a row for each contaminated document and item."""
    hits = docs.select("doc_id", contamination(F.col("text"), benchmark).alias("h"))
    return hits.select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")
