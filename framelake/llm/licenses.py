"""Operator 2, license scans: ordered signature rules with a keyword prefilter and interval-containment suppression.

Native: DataFrame and SQL functions only, no shuffle. A text becomes its words, lower-cased A-Z, with one space between.
Texts that hold none of the GATES are done then. In the others a rule is tried only where its first word stands and its
keyword occurs in the window of WINDOW words from there; its regular expression is anchored at that word. A detection is
suppressed if one of at least its rank (a smaller priority number, or the same and an earlier or longer one) contains it.
Base phrases are detections of their own that are never suppressed.

Null and empty texts have no words, no labels and score 0. score is the share of words that kept detections cover."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: label, regular expression of its name, first word of each name, keyword of each name
FAMILIES = [
    ("mit", r"mit", ["mit"], "mit"),
    ("mit-0", r"mit (?:no attribution|0)", ["mit"], "mit"),
    ("apache-2", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?", ["apache"], "apache"),
    ("apache-1-1", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1", ["apache"], "apache"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2(?: clause)?)", ["simplified", "freebsd", "bsd"], "bsd"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3(?: clause)?)", ["new", "modified", "revised", "bsd"], "bsd"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4(?: clause)?)", ["original", "bsd"], "bsd"),
    ("0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)", ["zero", "0bsd", "bsd"], "bsd"),
    ("gpl-2", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?2(?: 0)?(?: only)?", ["gnu", "general", "gpl", "gplv2"], "g"),
    ("gpl-3", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?v?3(?: 0)?(?: only)?", ["gnu", "general", "gpl", "gplv3"], "g"),
    ("lgpl-2-1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?2 1(?: only)?", ["gnu", "lesser", "lgpl"], "l"),
    ("lgpl-3", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?v?3(?: 0)?(?: only)?", ["gnu", "lesser", "lgpl", "lgplv3"], "l"),
    ("agpl-3", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? ?v?3(?: 0)?(?: only)?", ["gnu", "affero", "agpl", "agplv3"], "a"),
    ("mpl-2", r"(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2(?: 0)?", ["mozilla", "mpl"], "m"),
    ("epl-2", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?2(?: 0)?", ["eclipse", "epl"], "e"),
    ("epl-1", r"(?:eclipse public licen[cs]e|epl)(?: version| v)? ?1(?: 0)?", ["eclipse", "epl"], "e"),
    ("cddl-1", r"(?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1(?: 0)?", ["common", "cddl"], "d"),
    ("eupl-1-2", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2", ["european", "eupl"], "eu"),
    ("cc0", r"(?:cc0(?: 1 0)?|creative commons zero|cc zero)", ["cc0", "creative", "cc"], "c"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] 0)?", ["cc", "creative"], "c"),
    ("isc", r"isc", ["isc"], "isc"),
    ("zlib", r"zlib(?: libpng)?", ["zlib"], "zlib"),
    ("boost-1", r"(?:boost software licen[cs]e(?: version)?(?: 1 0)?|bsl 1 0|boost)", ["boost", "bsl"], "b"),
    ("unlicense", r"unlicen[cs]e", ["unlicense", "unlicence"], "unlicen"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to)(?: public)?(?: version 2)?", ["wtfpl", "do"], "w"),
    ("artistic-2", r"(?:perl )?artistic(?: licen[cs]e)?(?: version)? 2(?: 0)?", ["perl", "artistic"], "artistic"),
    ("python-2", r"(?:python software foundation|psf|python)(?: licen[cs]e)?(?: version)? 2(?: 0)?", ["python", "psf"], "p"),
    ("ofl-1-1", r"(?:sil )?(?:open font licen[cs]e|ofl)(?: version)?(?: 1 1)?", ["sil", "open", "ofl"], "o"),
    ("odbl", r"(?:open database licen[cs]e|odbl)(?: 1 0)?", ["open", "odbl"], "o"),
    ("ms-pl", r"(?:microsoft public|ms pl)", ["microsoft", "ms"], "m"),
    ("bsl-1-1", r"(?:business source|busl)(?: licen[cs]e)?(?: 1 1)?", ["business", "busl"], "bus"),
    ("sspl-1", r"(?:server side public|sspl)(?: licen[cs]e)?(?: version)?(?: 1(?: 0)?)?", ["server", "sspl"], "s"),
    ("elastic-2", r"elastic(?: licen[cs]e)?(?: version)?(?: 2(?: 0)?)?", ["elastic"], "elastic"),
    ("postgresql", r"postgresql", ["postgresql"], "postgresql"),
    ("openssl", r"openssl", ["openssl"], "openssl"),
]
#: priority, first words, keyword, expression with the family's name for {}
PHRASES = [
    (0, ["spdx"], "spdx", r"spdx licen[cs]e identifier {}"),
    (1, ["licensed", "licenced"], "licen", r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (1, ["released"], "released", r"released under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (1, ["distributed"], "distributed", r"distributed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (1, ["available"], "available", r"available under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (2, ["under"], "licen", r"under (?:the )?(?:terms of (?:the )?)?{} licen[cs]e"),
    (2, ["license", "licence"], "licen", r"licen[cs]e {}"),
]
#: priority, label, first word, keyword, expression
SINGLE = [
    (3, "public-domain", "public", "domain", r"public domain dedication"),
    (2, "public-domain", "dedicated", "public domain", r"dedicated to the public domain"),
    (2, "public-domain", "released", "public domain", r"released into the public domain"),
    (3, "proprietary", "all", "rights reserved", r"all rights reserved"),
    (3, "copyright", "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    (2, "mit", "permission", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (2, "bsd", "redistribution", "source and binary", r"redistribution and use in source and binary forms"),
    (2, "gpl", "either", "version", r"either version [23] of the licen[cs]e or at your option any later version"),
]
GATES = ["licen", "spdx", "copyright", "public domain", "rights reserved", "cc by", "free of charge", "source and binary", "released under", "distributed under", "available under"]


def rules() -> list[tuple[str, str, str, int, str]]:
    """(first word, keyword, expression, priority, label) in order of preference."""
    out = []
    for label, name, heads, key in FAMILIES:
        for priority, first, word, phrase in PHRASES:
            out += [(h, word, f"^(?:{phrase.format(name)})(?= |$)", priority, label) for h in first]
        out += [(h, "licen", f"^(?:{name} licen[cs]e)(?= |$)", 3, label) for h in heads if key in h or len(heads) > 1 or h == key]
    out += [(first, word, f"^(?:{x})(?= |$)", priority, label) for priority, label, first, word, x in SINGLE]
    # of two rules that begin alike the more specific one, with the longer label, is listed first
    return sorted(out, key=lambda r: (r[3], -len(r[4]), r[4], r[2]))


def _literal(rows: list[tuple]) -> Column:
    """An array of structs, as a constant."""
    made = [{"head": h, "word": w, "re": x, "prio": p, "label": n, "ord": k} for k, (h, w, x, p, n) in enumerate(rows)]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<head string, word string, re string, prio int, label string, ord int>>")


_FOUND = f"""
flatten(transform(
  filter(sequence(0, size(_w) - 1), i -> array_contains(_heads, _w[i])),
  i -> filter(transform(
    filter({{rules}}, r -> r.head = _w[i] and contains(array_join(slice(_w, i + 1, {WINDOW}), ' '), r.word)),
    r -> named_struct('start', i, 'neg', -(i + size(split(regexp_extract(array_join(slice(_w, i + 1, {WINDOW}), ' '), r.re, 0), ' '))),
                      'prio', r.prio, 'ord', r.ord, 'label', r.label,
                      'hit', regexp_extract(array_join(slice(_w, i + 1, {WINDOW}), ' '), r.re, 0) <> '')),
    d -> d.hit)))
"""
_KEPT = """
aggregate(array_sort(_dets), named_struct('ends', array(-1, -1, -1, -1), 'labels', cast(array() as array<string>), 'covered', 0, 'upto', 0),
  (s, d) -> if(exists(slice(s.ends, 1, d.prio + 1), e -> e >= -d.neg), s,
    named_struct('ends', transform(s.ends, (e, p) -> if(p = d.prio, greatest(e, -d.neg), e)),
                 'labels', array_union(s.labels, array(d.label)),
                 'covered', s.covered + greatest(0, -d.neg - greatest(s.upto, d.start)),
                 'upto', greatest(s.upto, -d.neg))))
"""


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (array of start, label) and kept (labels, covered words) of its texts; other columns stay."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SEPARATORS, " "))
    base = [(p.split()[0], p, f"^(?:{p})(?= |$)", 0, n) for p, n in BASE]
    heads = sorted({r[0] for r in [*rules(), *base]})
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(F.col("_low"), F.lit(g))
    out = docs.withColumn("_norm", words)
    out = out.withColumn("_low", F.lower("_norm")).withColumn("_gate", gate).drop("_low")
    lower = F.translate("_norm", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = out.withColumn("_w", F.when(F.col("_gate"), F.split(lower, " "))).withColumn("_heads", F.array(*map(F.lit, heads)))
    out = out.withColumn("_rules", _literal(rules())).withColumn("_base_rules", _literal(base))
    out = out.withColumn("_dets", F.when(F.col("_gate"), F.expr(_FOUND.format(rules="_rules"))))
    out = out.withColumn("_base", F.when(F.col("_gate"), F.expr(_FOUND.format(rules="_base_rules"))))
    out = out.withColumn("_kept", F.when(F.col("_gate"), F.expr(_KEPT)))
    n = F.when(F.col("_norm") == "", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1)
    return out.select(*[docs[c] for c in docs.columns], n.cast("long").alias("_n_words"), "_base", "_kept")


def detect(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    none = F.array().cast("array<string>")
    starts = F.transform("_base", lambda d: d["start"].cast("long"))
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("_base", lambda d: d["label"]))), none)
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.col("_kept.labels"), none)))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.round(F.col("_kept.covered") / F.col("_n_words"), 6), F.lit(0.0)).alias("score"),
    )
