"""Nested records as rows of (path, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all fields that aren't structs."""
    out = []
    for f in schema:
        path = (*prefix, f.name)
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def at(path: tuple[str, ...]) -> Column:
    c = F.col(f"`{path[0]}`")
    for name in path[1:]:
        c = c.getField(name)
    return c


def flattened(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(".".join(p)).alias("path"), at(p).cast("string").alias("value")) for p in leaves(df.schema) if p[0] not in keys]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def _entries(c: Column, kind: T.DataType, path: Column | None, sep: str) -> list[Column]:
    """Arrays of entries (path, value) of all leaves of c, whose own path is `path`."""
    below = lambda name: name if path is None else F.concat(path, F.lit(sep), name)
    if isinstance(kind, T.StructType):
        return [e for f in kind for e in _entries(c.getField(f.name), f.dataType, below(F.lit(f.name)), sep)]
    if isinstance(kind, T.ArrayType):
        inside = lambda x, k: joined(_entries(x, kind.elementType, below(k.cast("string")), sep))
        return [F.coalesce(F.flatten(F.transform(c, inside)), F.array().cast(_ENTRIES))]
    return [F.array(F.struct((F.lit("") if path is None else path).alias("path"), c.cast("string").alias("value")))]


_ENTRIES = "array<struct<path:string,value:string>>"


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(_ENTRIES)


def flattened_lists(df: DataFrame, keys: list[str], columns: list[str], sep: str = ".") -> DataFrame:
    """keys, path and value: a row for each leaf of the columns, inside structs and lists to any depth of their schema, with
    names and places joined by sep. Null and empty lists have none; a leaf, or a field of a struct, that is null has a null
    value."""
    parts = [_entries(F.col(f"`{c}`"), df.schema[c].dataType, F.lit(c), sep) for c in columns]
    return df.select(*keys, F.explode(joined([e for p in parts for e in p])).alias("_leaf")).select(*keys, "_leaf.path", "_leaf.value")


def mapped(df: DataFrame, kind: type[T.DataType], change) -> DataFrame:
    """change applied to every top-level column of a type."""
    return df.withColumns({f.name: change(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, kind)})


def deep(c: Column, kind: T.DataType, leaf: type[T.DataType], change) -> Column:  # noqa: ANN001
    """c, a column of type kind, with change applied to every value of type leaf inside structs, arrays and the values of
    maps, however deep; null structs, arrays and maps stay null."""
    if isinstance(kind, T.StructType):
        inside = F.struct(*[deep(c.getField(f.name), f.dataType, leaf, change).alias(f.name) for f in kind])
        return F.when(c.isNotNull(), inside)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: deep(x, kind.elementType, leaf, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: deep(x, kind.valueType, leaf, change))
    return change(c) if isinstance(kind, leaf) else c


def deep_mapped(df: DataFrame, leaf: type[T.DataType], change) -> DataFrame:  # noqa: ANN001
    """All columns with every value of a type changed, at any depth of their schema."""
    return df.select(*[deep(F.col(f"`{f.name}`"), f.dataType, leaf, change).alias(f.name) for f in df.schema])


def deep_types(kind: T.DataType, leaf: type[T.DataType], to: T.DataType) -> T.DataType:
    """kind with every type leaf replaced; df.select(c.cast(...)) recasts a nested column at once."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, deep_types(f.dataType, leaf, to), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(deep_types(kind.elementType, leaf, to), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, deep_types(kind.valueType, leaf, to), kind.valueContainsNull)
    return to if isinstance(kind, leaf) else kind


def deep_cast(df: DataFrame, leaf: type[T.DataType], to: T.DataType) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(deep_types(f.dataType, leaf, to)).alias(f.name) for f in df.schema])


def shape(c: Column, kind: T.DataType) -> Column:
    """Sizes of a nested array along its dimensions; null where rows of one dimension differ in size."""
    if not isinstance(kind, T.ArrayType):
        return F.array().cast("array<int>")
    if not isinstance(kind.elementType, T.ArrayType):
        return F.array(F.size(c))
    inner = F.array_distinct(F.transform(c, lambda x: shape(x, kind.elementType)))
    return F.when(F.size(c) == 0, F.array(F.size(c))).when((F.size(inner) == 1) & inner[0].isNotNull(), F.concat(F.array(F.size(c)), inner[0]))


def expect_size(c: Column, kind: T.DataType, dim: int, size: int) -> Column:
    """c, or an error where its size along a dimension is another."""
    own = shape(c, kind)
    found = F.try_element_at(own, F.lit(dim + 1 if dim >= 0 else dim))
    why = F.concat(F.lit(f"size {size} expected along dimension {dim}, the shape is "), F.coalesce(own.cast("string"), F.lit("ragged")))
    return F.when(c.isNull() | F.coalesce(found == size, F.lit(False)), c).otherwise(F.raise_error(why))


def over_time(c: Column, step) -> Column:  # noqa: ANN001
    """step applied to what each time step of a sequence holds; null steps stay null."""
    return F.transform(c, lambda x: F.when(x.isNotNull(), step(x)))
