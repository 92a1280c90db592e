"""JSON-safe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _safe(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = F.abs(value) == F.lit(float("inf"))
        return F.when(F.isnan(value) | infinite, F.lit(0.0).cast(kind)).otherwise(value)
    if isinstance(kind, T.ArrayType) and _has_floats(kind):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_floats(kind.valueType):
        return F.transform_values(value, lambda _, x: _safe(x, kind.valueType))
    if isinstance(kind, T.StructType) and _has_floats(kind):
        fields = [_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def sanitize_numeric(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by 0.0, also inside arrays, maps and structs."""
    return df.select(
        *[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text, safe for strict parsers."""
    safe = sanitize_numeric(df)
    return safe.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), {"ignoreNullFields": "false"}).alias(name)
    )


def write_json(df: DataFrame, path: str) -> None:
    sanitize_numeric(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
