"""Operator 1, language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of non-letters becomes one gap; n-grams of one to three characters are hashed to a
fixed number of buckets. Training counts all n-grams of all labelled texts by (language, bucket), pre-aggregated in each
task; the matrix of log-probabilities has languages x buckets entries whatever the corpus size, is checked against
MAX_LANGUAGES, and is broadcast. Scoring is a sparse product of a batch of texts with it, in numpy.

Null texts and texts without a letter are `und` with score 0, as is every text when nothing was there to learn from.
Ties go to the language that sorts first. Rows are never dropped, so repeated rows give repeated results."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import lean, release, remainder, scratch, written

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 1024
PIECE = 1 << 20  # characters hashed at once

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case code point, 0 unless it is a letter; made once in a worker."""
    if not _tables:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if unicodedata.category(s := chr(c))[0] == "L":
                t[c] = ord(s.lower()[0])
        _tables.append(t)
    return _tables[0]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters, with 0 for every run of other characters and at both ends; empty without a letter."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not c.any():
        return c[:0]
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def _grams(codes: np.ndarray, known: int = 0) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, but for those inside the first `known` codes."""
    part = codes.astype(np.uint64)
    for n in ORDERS:
        first = max(0, known - n + 1)
        if (m := len(part) - n + 1 - first) > 0:
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ part[first + k : first + k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs in a text of any length, read in pieces; null without a letter."""
    sums, seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64), False
    carry = np.zeros(1, dtype=np.uint32)
    for at in range(0, len(text) + 1, PIECE):
        c = _letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        seen = seen or bool(c.any())
        if at + PIECE > len(text):
            c = np.concatenate([c, [0]]).astype(np.uint32)
        new = c[(c != 0) | (np.concatenate([carry[-1:], c[:-1]]) != 0)]
        codes = np.concatenate([carry, new])
        # the first gap is counted with the first piece
        for g in _grams(codes, len(carry) if at else 0):
            sums += np.bincount(g, minlength=1 << BUCKET_BITS)
        carry = codes[1 - max(ORDERS) :]
    return sums if seen else None


@dataclass
class Model:
    """Languages in order, log-probabilities of their buckets, and log-priors. An empty string is a language like any other."""

    names: list[str]
    weights: np.ndarray
    priors: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1), strict=True):
                own = _counts(t.as_py())
                sums = found.setdefault(name.as_py(), np.zeros((1 << BUCKET_BITS) + 1, dtype=np.int64))
                if len(found) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                sums[-1] += 1
                if own is not None:
                    sums[:-1] += own
        for name, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    with scratch(docs.sparkSession):
        sums = written(rows.mapInArrow(lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        if (names := sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()) > MAX_LANGUAGES:
            raise ValueError(f"{names} languages; at most {MAX_LANGUAGES}")
        got = sums.toPandas()  # at most languages x buckets rows
    size = 1 << BUCKET_BITS
    names = sorted(got["lang"].unique())
    counts = np.zeros((len(names), size + 1))
    counts[np.searchsorted(names, got["lang"].to_numpy(dtype=str)) if names else [], got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    texts, grams = counts[:, -1], counts[:, :-1]
    return Model(names, np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * size)), np.log(texts / max(1.0, texts.sum())))


def _products(group: list[np.ndarray], m: Model) -> np.ndarray:
    """Texts x languages: the rows of counts of n-grams times the matrix of log-probabilities, for texts with a letter."""
    grams = [np.concatenate(list(_grams(c))) for c in group]
    start = np.cumsum([0, *map(len, grams[:-1])])
    flat = np.concatenate(grams)
    return np.stack([np.add.reduceat(w.take(flat), start) for w in m.weights], axis=1) + m.priors


def scores(texts: Sequence[str | None], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text. Short texts go together, up to PIECE characters; the counts of a long one are summed
    piece by piece first, so memory doesn't grow with texts or batches."""
    names, out = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))

    def put(at: list[int], sums: np.ndarray) -> None:
        names[at] = np.array(m.names, dtype=object)[sums.argmax(1)]
        out[at] = np.round(1 / np.exp(np.minimum(sums - sums.max(1, keepdims=True), 0)).sum(1), 6)

    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, t in enumerate(texts if m.names else ()):
        if t is not None and len(t) > PIECE:
            if (own := _counts(t)) is not None:
                put([k], (m.weights @ own + m.priors)[None])
            continue
        codes = _codes(t) if t is not None else ()
        if not len(codes):
            continue
        if held and (size + len(codes) > PIECE or len(held) == 200):
            put([i for i, _ in held], _products([c for _, c in held], m))
            held, size = [], 0
        held.append((k, codes))
        size += len(codes)
    if held:
        put([i for i, _ in held], _products([c for _, c in held], m))
    return names, out


def predict(text: Column, model: Model) -> Column:
    """struct<lang_pred string, score double>; score is the posterior probability of the language."""
    shared = SparkContext.getOrCreate().broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, found = scores(texts.tolist(), shared.value)
            yield pd.DataFrame({"lang_pred": names, "score": found})
        release()

    return scored(text)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang): doc_id, held_out, lang_pred, score; learns from ids whose remainder by 4 is not 2."""
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return rows.select("doc_id", "held_out", predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
