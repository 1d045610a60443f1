"""Documents without a schema: VARIANT values walked to any depth by one expression, in one pass and without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the children of a variant as entries (path, value): of an object by name, of an array by place
_CHILDREN = """coalesce(
  transform(map_entries(try_variant_get({v}, '$', 'map<string,variant>')), e -> named_struct('path', concat({p}, '{sep}', e.key), 'value', e.value)),
  transform(try_variant_get({v}, '$', 'array<variant>'), (x, k) -> named_struct('path', concat({p}, '{sep}', k), 'value', x)),
  cast(array() AS array<struct<path:string,value:variant>>))"""
_ENTRIES = "cast(array() AS array<struct<path:string,value:variant>>)"
_CONTAINER = "(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL OR try_variant_get({v}, '$', 'array<variant>') IS NOT NULL)"
_TEXT = "coalesce(try_variant_get({v}, '$', 'string'), to_json({v}))"


def _rounds(v: str) -> str:
    """As many steps as a document holds objects and arrays, so as many as it can be deep."""
    return f"sequence(1, greatest(1, regexp_count(to_json({v}), '[\\\\[{{]') + 1))"


def nested_values(v: str, name: str) -> Column:
    """Texts of all fields of this name at any depth of the variant column v; what stands inside such a field isn't searched.
    Null for a null document."""
    inside = _CHILDREN.format(v="t.value", p="''", sep="")
    own = f"try_variant_get(t.value, '$', 'map<string,variant>')['{name}']"
    return F.expr(f"""if({v} IS NULL, NULL, aggregate({_rounds(v)}, named_struct('todo', array(named_struct('path', '', 'value', {v})), 'found', cast(array() AS array<string>)),
      (s, i) -> named_struct(
        'todo', flatten(transform(s.todo, t -> filter({inside}, c -> c.path <> '{name}' OR try_variant_get(t.value, '$', 'map<string,variant>') IS NULL))),
        'found', concat(s.found, transform(filter(s.todo, t -> coalesce(map_contains_key(try_variant_get(t.value, '$', 'map<string,variant>'), '{name}'), false)), t -> {_TEXT.format(v=own)}))),
      s -> s.found))""")


def all_among(v: str, name: str, allowed: list[str]) -> Column:
    """Whether the document has fields of this name and each of them, at any depth, is one of the texts allowed."""
    found = nested_values(v, name)
    return F.coalesce((F.size(found) > 0) & F.forall(found, lambda x: F.coalesce(x.isin(allowed), F.lit(False))), F.lit(False))


def leaves(v: str, sep: str = ".") -> Column:
    """array<struct<path, value>> of all values that are neither objects nor arrays, with names and places joined by sep;
    empty objects and arrays have none. A document that is a single value has the path ''."""
    below = _CHILDREN.format(v="t.value", p="t.path", sep=sep)
    is_leaf = f"NOT {_CONTAINER.format(v='t.value')}"
    return F.expr(f"""if({v} IS NULL, NULL, aggregate({_rounds(v)}, named_struct('todo', array(named_struct('path', '', 'value', {v})), 'found', {_ENTRIES}),
      (s, i) -> named_struct('todo', flatten(transform(s.todo, t -> {below})), 'found', concat(s.found, filter(s.todo, t -> {is_leaf}))),
      s -> transform(s.found, t -> named_struct('path', substring(t.path, {len(sep) + 1}), 'value', try_variant_get(t.value, '$', 'string')))))""")


def flattened(df: DataFrame, keys: list[str], v: str, sep: str = ".") -> DataFrame:
    """keys, path and value: a row for each leaf of the variant column v."""
    return df.withColumn("_leaf", F.explode(leaves(v, sep))).select(*keys, "_leaf.path", "_leaf.value")


def as_variant(columns: list[str]) -> Column:
    """Nested columns as one document: structs become objects, arrays arrays; maps with text keys become objects."""
    return F.to_variant_object(F.struct(*columns))


def feature_status(doc: str, version: str, wanted: str, good: list[str]) -> Column:
    """MISSING (no document, or none that parses), VERSION_MISMATCH, FAILED (it has statuses and not all are good) or OK."""
    own = F.coalesce(F.expr(f"try_variant_get({doc}, '$.{version}', 'string')"), F.lit(""))
    failed = (F.size(nested_values(doc, "status")) > 0) & ~all_among(doc, "status", good)
    return F.when(F.col(doc).isNull(), "MISSING").when(own != wanted, "VERSION_MISMATCH").when(failed, "FAILED").otherwise("OK")
