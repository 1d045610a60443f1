"""Operator 13, fill-in-the-middle by displacement scatter.

A text of n tokens (a word with the spaces before it; spaces at the end are a token) is cut twice at places drawn from a hash
of its id, and its parts change places between the marks `<P>`, `<S>` and `<M>`. A whole Arrow batch is one array of bytes:
a scan finds the cuts, three entries a text in a difference array say by how much each byte moves, their cumulative sum is
every byte's shift, and one scatter writes all outputs. restored() reads the marks of an output, builds the same shifts and
gathers the bytes back. Scan, scatter and gather go in blocks, so memory is the batch and its output whatever a text's length.

A text stays as it is (form `plain`) if it is empty, null or holds a mark, and else for a share of the ids. A null id draws as
the empty string does; rows with the same id are cut alike if their texts are alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.scan import Texts, text_array

#: percent of the texts that are cut, and of those the percent whose suffix comes first
CUT, SUFFIX_FIRST = 50, 80
SEED = 42
_PLAIN, _PSM, _SPM = range(3)
_FORMS = np.array(["plain", "psm", "spm"], dtype=object)
#: the marks in the order in which each form has them
_MARKS = {_PSM: b"PSM", _SPM: b"SPM"}
MADE = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def _marks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all marks inside texts: where they stand, their letters and the numbers of their texts."""
    found = []
    for low, high in t.blocks():
        d = t.data[low : high + 2]
        k = np.flatnonzero((d[:-2] == ord("<")) & (d[2:] == ord(">")))
        found.append(k[np.isin(d[k + 1], np.frombuffer(b"PSM", np.uint8))] + low)
    where = np.concatenate([np.zeros(0, np.int64), *found])
    text = np.searchsorted(t.at, where, "right") - 1
    inside = where + 3 <= t.at[text + 1]
    return where[inside], t.data[where[inside] + 1], text[inside]


def _places(form: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix of lengths a, b and c begin in outputs that begin at start."""
    cut, spm = form != _PLAIN, form == _SPM
    prefix = start + np.where(spm, 6 + c, 3 * cut)
    suffix = start + np.where(spm, 3, a + np.where(cut, 6, b))
    return prefix, np.where(cut, start + 9 + a + c, start + a), suffix


def _shifts(t: Texts, edges: list[np.ndarray], places: tuple[np.ndarray, ...]):  # noqa: ANN202
    """By block (low, high) of the source bytes the place of each in the output. edges: where the three parts begin."""
    moves = [p - e for p, e in zip(places, edges, strict=True)]
    before = np.concatenate([[0], moves[2][:-1]])  # the shift of the text before
    at = np.concatenate(edges)
    step = np.concatenate([moves[0] - before, moves[1] - moves[0], moves[2] - moves[1]])
    order = np.argsort(at, kind="stable")
    at, step, carry = at[order], step[order], 0
    for low, high in t.blocks():
        k = slice(np.searchsorted(at, low), np.searchsorted(at, high))
        shift = np.zeros(high - low, np.int64)
        np.add.at(shift, at[k] - low, step[k])
        shift[0] += carry
        np.cumsum(shift, out=shift)
        carry = int(shift[-1])
        shift += np.arange(low, high)
        yield low, high, shift


def _cut(texts: pa.Array, draws: pa.Array) -> pa.Array:
    t = Texts(texts)
    size = len(t.at) - 1
    h = np.frombuffer(b"".join(x[:16] for x in draws.to_pylist()), dtype=">u4").reshape(size, 4).astype(np.int64)
    before = t.words_before()
    words = np.diff(before)
    n = words + t.ends_in_space()
    form = np.where(h[:, 3] % 100 < SUFFIX_FIRST, _SPM, _PSM)
    form[(t.at[1:] == t.at[:-1]) | (h[:, 2] % 100 >= CUT)] = _PLAIN
    form[_marks(t)[2]] = _PLAIN
    units = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    edges = [t.at[:-1]]
    for k in units.T:
        inside = (k > 0) & (k <= words)
        edges.append(np.where(inside, t.after_word(np.where(inside, before[:-1] + k - 1, -1)), np.where(k > 0, t.at[1:], t.at[:-1])))
    chars = np.diff([t.characters_before(e) for e in edges], axis=0)
    a, b, c = edges[1] - edges[0], edges[2] - edges[1], t.at[1:] - edges[2]
    out_at = np.concatenate([[0], np.cumsum(a + b + c + 9 * (form != _PLAIN))])
    places = _places(form, a, b, c, out_at[:-1])
    out = np.empty(int(out_at[-1]), np.uint8)
    for low, high, to in _shifts(t, edges, places):
        out[to] = t.data[low:high]
    for kind, letters in _MARKS.items():
        k = np.flatnonzero(form == kind)
        first = places[0] if kind == _PSM else places[2]
        second = places[2] if kind == _PSM else places[0]
        for letter, place in zip(letters, (first, second, places[1]), strict=True):
            for j, byte in enumerate((ord("<"), letter, ord(">"))):
                out[place[k] - 3 + j] = byte
    plain = form == _PLAIN
    columns = [pa.array(n), pa.array(_FORMS[form], pa.string()), pa.array(chars[0], mask=plain), pa.array(chars[1], mask=plain), text_array(out, out_at)]
    return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])


def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    t = Texts(outputs)
    form = np.select([np.asarray(forms) == "psm", np.asarray(forms) == "spm"], [_PSM, _SPM], _PLAIN)
    where, letter, text = _marks(t)
    own = form[text] != _PLAIN
    cut = np.flatnonzero(form != _PLAIN)
    where, letter = where[own], letter[own]
    want = np.array([list(_MARKS[f]) for f in form[cut]], np.uint8).reshape(-1, 3)
    if not (np.array_equal(text[own], np.repeat(cut, 3)) and np.array_equal(letter.reshape(-1, 3), want)):
        raise ValueError("an output doesn't hold the marks of its form")
    a, b, c = np.zeros((3, len(form)), np.int64)
    c[:] = np.diff(t.at)
    one, two, three = where.reshape(-1, 3).T
    spm = form[cut] == _SPM
    a[cut] = np.where(spm, three - two, two - one) - 3
    c[cut] = np.where(spm, two - one, three - two) - 3
    b[cut] = t.at[cut + 1] - three - 3
    at = np.concatenate([[0], np.cumsum(a + b + c)])
    source = Texts(text_array(np.empty(int(at[-1]), np.uint8), at))
    edges = [at[:-1], at[:-1] + a, at[:-1] + a + b]
    out = np.empty(int(at[-1]), np.uint8)
    for low, high, back in _shifts(source, edges, _places(form, a, b, c, t.at[:-1])):
        out[low:high] = t.data[back]
    return text_array(out, at)


def transformed(text: Column, doc_id: Column) -> Column:
    """struct n, form, prefix_chars, middle_chars, output."""
    drawn = F.unhex(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256))
    return F.arrow_udf(_cut, MADE)(text, drawn)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    return F.arrow_udf(_restored, "string")(output, form)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output."""
    return docs.select("doc_id", transformed(F.col("text"), F.col("doc_id")).alias("_m")).select("doc_id", "_m.*")


def digests(made: DataFrame) -> DataFrame:
    """fill_in_middle() with digests in place of the output and of the text restored from it."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS w, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM d),
k AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(w[:a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 :], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
