"""Operator 4, BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 characters cuts each text where its low bits are zero, so equal passages give equal chunks
wherever they stand. The part of a chunk between its first and last white space is encoded once in a worker: its ids are kept
for its digest and reused by each later document that holds it, and equal words of new chunks are encoded once. What lies
between two such parts is a join. It is repaired by encoding a window of the text that also holds the last word of the part
before and the first word of the part after it: the window's ids must begin and end with the ids that these words have in
their parts. Where they don't, the window widens on both sides, up to the whole text, until they agree.

Stores are bounded: beyond their size chunks start afresh, and words that the texts at hand don't hold go. There is no shuffle: a global dictionary of chunks would move the
whole text and all ids. The vocabulary must be one whose decoder joins tokens by a space, as that of word_bpe_49k.json does.

Null texts count as empty: no ids. Every row gives one row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import release

CUT_BITS = 10  # chunks of 1,024 characters on average
LEAST = 64  # characters of the inner part of a chunk
MAX_WORDS, MAX_CHUNKS = 125_000, 5_000
GROUP = 1_000_000  # characters of the texts encoded at once, about
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: letters, then other signs without an apostrophe: one pre-token for either, whatever stands around the word
PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 1 << 12, dtype=np.uint64)

Piece = tuple[int, bytes, bytes]  # number of ids, " id" for each, " token" for each


def split(s: str) -> list[str]:
    """Words between ASCII white space."""
    return [x for x in SPACE.split(s) if x] if OTHER_SPACE.search(s) else s.split()


class Chunk:
    """The inner part of a chunk: its words until they are encoded, where its first word ends and its last word starts, and
    the pieces of the whole, the first and the last word."""

    __slots__ = ("words", "head", "tail", "piece", "first", "last")

    def __init__(self, s: str, words: list[str]):
        self.words = words
        self.head = s.index(words[0]) + len(words[0])
        self.tail = s.rindex(words[-1])


class Encoder:
    """The tokenizer of a worker, with its stores of words and chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("a vocabulary with a decoder of its own")
        tokens = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.ids = [b" %d" % k for k in range(len(tokens))]
        self.tokens = [b" " + t.encode() for t in tokens]
        self.ends = np.array([t.endswith("</w>") for t in tokens])
        self.most = MAX_WORDS
        self.words: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}
        self.chunks: dict[bytes, Chunk] = {}

    def piece(self, ids: list[int]) -> Piece:
        return len(ids), b"".join([self.ids[k] for k in ids]), b"".join([self.tokens[k] for k in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encodes new words, plain ones in lines of many: the ends of their pre-tokens tell them apart."""
        if len(self.words) > self.most:  # words that don't come again before the next time go
            self.old, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                if (x := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.words[w] = x
        plain = [(w, 1 + bool(m[2])) for w in new if (m := PLAIN.fullmatch(w))]
        for at in range(0, len(plain), 20_000):
            lines = [plain[k : k + 100] for k in range(at, min(at + 20_000, len(plain)), 100)]
            for line, ids in zip(lines, self.encode([" ".join([w for w, _ in line]) for line in lines]), strict=True):
                ends = np.flatnonzero(self.ends[ids]) + 1
                stops = np.cumsum([k for _, k in line])
                if len(ends) != stops[-1]:
                    continue  # these are encoded one by one
                a = 0
                for (w, _), b in zip(line, ends[stops - 1].tolist(), strict=True):
                    self.words[w] = self.piece(ids[a:b])
                    a = b
        rest = [w for w in new if w not in self.words]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            self.words.update(zip(part, map(self.piece, self.encode(part)), strict=True))

    def joined(self, words: list[str]) -> Piece:
        got = [self.words[w] for w in words]
        return sum([x[0] for x in got]), b"".join([x[1] for x in got]), b"".join([x[2] for x in got])


_encoders: dict[str, Encoder] = {}


def cuts(text: str) -> list[int]:
    """Where the rolling hash cuts the text, with both ends."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = _GEAR[c & 0xFFF]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return [0, *(np.flatnonzero(h[:-1] >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist(), len(text)]


def parts(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the inner parts of chunks, each from a white space to one; what lies between them is joins. Parts
    shorter than LEAST are left to the joins."""
    at = cuts(text)
    for a, b in zip(at, at[1:], strict=False):
        first = SPACE.search(text, a, b)
        if not first:
            continue
        last = b
        while text[last - 1] not in " \t\n\r\x0b\x0c":
            last -= 1
        if last - first.start() > LEAST and not text[first.start() : last].isspace():
            yield first.start(), last


def repaired(window: Piece, before: Piece | None, after: Piece | None) -> Piece | None:
    """What a window holds between the word before and the word after it; null where their ids don't agree."""
    a, b = before or (0, b"", b""), after or (0, b"", b"")
    n, ids, tokens = window
    if n < a[0] + b[0] or not ids.startswith(a[1]) or not ids.endswith(b[1]) or ids[len(a[1]) : len(a[1]) + 1] not in (b"", b" "):
        return None
    return n - a[0] - b[0], ids[len(a[1]) : len(ids) - len(b[1])], tokens[len(a[2]) : len(tokens) - len(b[2])]


def encode_texts(texts: list[str | None], encoder: Encoder) -> Iterator[Piece]:
    """Ids and tokens of each text."""
    plans, need, fresh = [], set(), {}
    windows: list[str] = []
    for text in texts:
        plan, opened = [], 0
        for a, b in parts(text) if text else ():
            s = text[a:b]
            key = xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
            if (c := encoder.chunks.get(key) or fresh.get(key)) is None:
                c = fresh[key] = Chunk(s, split(s))
                need.update(c.words)
            windows.append(text[opened : a + c.head])
            plan.append(c)
            opened = a + c.tail
        windows.append(text[opened:] if text else "")
        plans.append(plan)
    encoder.learn(need)
    for c in fresh.values():
        c.piece, c.first, c.last = encoder.joined(c.words), encoder.words[c.words[0]], encoder.words[c.words[-1]]
        c.words = []
    if len(encoder.chunks) + len(fresh) > MAX_CHUNKS:
        encoder.chunks = {}
    encoder.chunks.update(fresh)
    encoded: list[Piece] = []
    for at in range(0, len(windows), 5000):
        encoded += map(encoder.piece, encoder.encode(windows[at : at + 5000]))
    joins = iter(encoded)
    for text, plan in zip(texts, plans, strict=True):
        got, before = [], None
        for c in [*plan, None]:
            got.append(repaired(next(joins), before, c and c.first))
            if c:
                got.append(c.piece)
                before = c.last
        if None in got:
            got = _widened(text, got, encoder)
        yield sum([x[0] for x in got]), b"".join([x[1] for x in got]), b"".join([x[2] for x in got])


def _widened(text: str, got: list[Piece | None], encoder: Encoder) -> list[Piece]:
    """The pieces of a text whose joins didn't all agree: each such join takes in the parts beside it and is encoded anew,
    over more parts as long as the ids of its outer words differ, at last over the whole text."""
    spans, opened = [], 0
    for a, b in parts(text):
        spans += [(opened, a), (a, b)]
        opened = b
    spans.append((opened, len(text)))
    for reach in (1, 2, 4, 8):
        out, k = list(got), 0
        while None in out:
            k = out.index(None)
            a, b = max(0, k - 2 * reach + 1), min(len(out), k + 2 * reach)
            lo, hi = spans[a][0], spans[b - 1][1]
            words = split(text[lo:hi])
            whole, edge = encoder.piece(encoder.encode([text[lo:hi]])[0]), [encoder.piece(x) for x in encoder.encode([words[0], words[-1]])]
            wider = encoder.encode([text[:lo][-LEAST:] + text[lo:hi] + text[hi:][:LEAST]])[0]
            if repaired(whole, *edge) is None or whole[1] not in encoder.piece(wider)[1]:
                break
            out[a:b] = [whole] + [(0, b"", b"")] * (b - a - 1)
        if None not in out:
            return out
    return [encoder.piece(encoder.encode([text])[0])]


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _udf(path: Callable[[], str], schema: str, row: Callable[[Piece], tuple], words: int, most: int = GROUP) -> Callable[[Column], Column]:
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path())
        encoder.most = words
        names = [x.split()[0] for x in schema.split(", ")]
        for texts in batches:
            out, group, size = [], [], 0
            for t in texts:  # groups of bounded size
                group.append(t)
                size += len(t or "")
                if size > most:
                    out += map(row, encode_texts(group, encoder))
                    group, size = [], 0
            out += map(row, encode_texts(group, encoder))
            yield pd.DataFrame(out, columns=names)
        encoder.words, encoder.old = {}, {}  # a worker lives on and runs other operators; chunks stay
        release()

    return run


def encode(text: Column, path: Callable[[], str], words: int = MAX_WORDS) -> Column:
    """struct<ids array<int>, decoded string> of a text column. words: of so many words, twice, a worker keeps the pieces;
    more save encoding, about a kilobyte each, and results don't depend on it."""
    return _udf(path, "ids array<int>, decoded string", lambda x: ([int(i) for i in x[1].split()], x[2][1:].decode()), words)(text)


def digests(text: Column, path: Callable[[], str], words: int = MAX_WORDS, group: int = GROUP) -> Column:
    """struct<n_tokens long, ids_sha256 string, decoded_sha256 string> of a text column. group: characters encoded at once."""
    sha = lambda b: hashlib.sha256(b[1:]).hexdigest()
    return _udf(path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda x: (x[0], sha(x[1]), sha(x[2])), words, group)(text)


def vocabulary() -> str:
    """Place of the vocabulary file on the machine where this is called."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, path: Callable[[], str] = vocabulary) -> DataFrame:
    """docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("p")).select("doc_id", "p.*")
