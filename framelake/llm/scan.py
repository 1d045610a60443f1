"""Scans of whole Arrow batches of text as bytes, in blocks of bounded size whatever the length of a text.

Words are runs of anything but `[\\x20\\x09-\\x0D]`. These are single bytes in UTF-8 and part of no other character, so bytes
can be scanned in place of code points. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Texts:
    """The bytes of a batch; text k is data[at[k] : at[k + 1]]."""

    def __init__(self, texts: pa.Array) -> None:
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        empty = offsets is None or not len(texts)
        self.at = np.zeros(len(texts) + 1, np.int64) if empty else np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def blocks(self) -> Iterator[tuple[int, int]]:
        for low in range(int(self.at[0]), int(self.at[-1]), BLOCK):
            yield low, min(low + BLOCK, int(self.at[-1]))

    def word_ends(self) -> Iterator[np.ndarray]:
        """Where the last byte of each word stands, block by block."""
        ends = self.at[1:][self.at[1:] > self.at[:-1]] - 1
        for low, high in self.blocks():
            space = _SPACE[self.data[low : high + 1]]
            last = ~space[: high - low]
            last[: len(space) - 1] &= space[1:]
            own = ends[np.searchsorted(ends, low) : np.searchsorted(ends, high)]
            last[own - low] = ~_SPACE[self.data[own]]
            yield np.flatnonzero(last) + low

    def words_before(self) -> np.ndarray:
        """How many words of the batch end before each entry of at."""
        return sum((np.searchsorted(p, self.at) for p in self.word_ends()), np.zeros(len(self.at), np.int64))

    def after_word(self, k: np.ndarray) -> np.ndarray:
        """Where the batch's words of these numbers (from 0) end."""
        out, before = np.zeros(len(k), np.int64), 0
        for p in self.word_ends():
            here = (k >= before) & (k < before + len(p))
            out[here] = p[k[here] - before] + 1
            before += len(p)
        return out

    def ends_in_space(self) -> np.ndarray:
        """Whether each text's last byte is a space; false for an empty text."""
        out = self.at[1:] > self.at[:-1]
        out[out] = _SPACE[self.data[self.at[1:][out] - 1]]
        return out

    def characters_before(self, where: np.ndarray) -> np.ndarray:
        """How many code points of the batch begin before each of these places."""
        out, before = np.zeros(len(where), np.int64), 0
        for low, high in self.blocks():
            begun = np.cumsum((self.data[low:high] & 0xC0) != 0x80, dtype=np.int64) + before
            here = (where > low) & (where <= high)
            out[here] = begun[where[here] - low - 1]
            before = int(begun[-1])
        return out


def text_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings data[at[k] : at[k + 1]]; at begins with 0."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))



def _counted(texts: pa.Array) -> pa.Array:
    return pa.array(np.diff(Texts(texts).words_before()))


def _heads(texts: pa.Array, words: pa.Array) -> pa.Array:
    t = Texts(texts)
    before = t.words_before()
    k = np.clip(np.asarray(words.fill_null(0), dtype=np.int64), 0, np.diff(before))
    end = np.where(k > 0, t.after_word(before[:-1] + k - 1), t.at[:-1])
    return pa.array([t.data[a:b].tobytes().decode() for a, b in zip(t.at[:-1], end, strict=True)], pa.string())


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.arrow_udf(_counted, "long")(text)


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of so many words; all words of it where there are fewer."""
    return F.arrow_udf(_heads, "string")(text, words)
