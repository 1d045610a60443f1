"""Operator 6, chat formatting with a grammar round trip.

Native: DataFrame and SQL functions only. A conversation is rendered as `<|im_start|>role\\ntext<|im_end|>\\n` for each turn.
The rendered string is parsed again by a deterministic grammar: split at turn ends, each part must open with the start mark
and hold no further mark, the role ends at the first line end, and escapes are undone. If the turns that come back differ
from the source, its roles and texts are escaped (`%` as %25, `<|` as %3C|, a line end in a role as %0A) and it is rendered
and parsed again; a conversation that still differs stops the query.

Turns go by turn, then role and text, null first; null roles and texts count as empty; a null conv_id is a conversation of
its own; repeated rows are repeated turns. A conversation is one output string, so its turns meet in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escaped(x: Column) -> Column:
    return _replaced(x, ("%", "%25"), ("<|", "%3C|"))


def unescaped(x: Column) -> Column:
    return _replaced(x, ("%0A", "\n"), ("%3C|", "<|"), ("%25", "%"))


def rendered(turns: Column) -> Column:
    """One string for an array of struct<role, text>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def parsed(text: Column) -> Column:
    """array<struct<role, text>> read from a rendered string; null where the grammar doesn't hold."""
    parts = F.split(text, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    good = F.forall(parts, lambda p: p.startswith(START) & ~F.contains(F.substr(p, F.lit(len(START) + 1)), F.lit("<|im_")) & F.contains(p, F.lit("\n")))
    turn = lambda p: F.struct(
        unescaped(F.substr(p, F.lit(len(START) + 1), F.instr(p, "\n") - len(START) - 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
    )
    return F.when(F.endswith(text, F.lit(END)) & good, F.transform(parts, turn))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): conv_id, formatted, turns as parsed back, and loss_spans, the (start, length) in
    code points of each assistant text inside formatted, read from formatted by the same grammar."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    plain = F.transform("_rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.select("conv_id", plain.alias("_plain")).withColumn("_first", rendered(F.col("_plain")))
    convs = convs.withColumn("_same", F.coalesce(parsed(F.col("_first")) == F.col("_plain"), F.lit(False)))
    safe = F.transform("_plain", lambda t: F.struct(_replaced(escaped(t["role"]), ("\n", "%0A")).alias("role"), escaped(t["text"]).alias("text")))
    convs = convs.withColumn("_shown", F.when(F.col("_same"), F.col("_plain")).otherwise(safe))
    convs = convs.withColumn("formatted", F.when(F.col("_same"), F.col("_first")).otherwise(rendered(F.col("_shown"))))
    convs = convs.withColumn("turns", parsed(F.col("formatted")))
    convs = convs.withColumn("turns", F.when(F.col("turns") == F.col("_plain"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't survive its round trip"))))
    spans = F.expr(
        rf"""aggregate(split(formatted, r'<\|im_end\|>\n', -1), named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)),
        (s, p) -> named_struct('at', s.at + length(p) + {len(END)},
          'spans', if(startswith(p, '{START}assistant\n'), concat(s.spans, array(named_struct('start', s.at + instr(p, '\n'), 'length', length(p) - instr(p, '\n')))), s.spans)),
        s -> s.spans)"""
    )
    return convs.select("conv_id", "formatted", "turns", spans.alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """The checkable columns of what format_chats returns, all read back from the formatted string."""
    under = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = F.array_join(under, "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
u AS (
  SELECT *, contains(role || text, '<|im_') OR contains(role, chr(10)) OR contains(role || chr(10) || text, '%25')
            OR contains(role || chr(10) || text, '%3C|') OR contains(role || chr(10) || text, '%0A') AS odd,
         length(role) + length(text) + 24 AS plain,
         length(role) + length(text) + 24
           + 2 * (length(role || text) - length(replace(role || text, '%', '')))
           + length(role) - length(replace(role, '<|', '')) + length(text) - length(replace(text, '<|', ''))
           + 2 * (length(role) - length(replace(role, chr(10), ''))) AS escaped
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(CASE WHEN bool_or(odd) THEN sum(escaped) ELSE sum(plain) END AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
