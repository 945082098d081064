"""Value ranks, schema paths and literals: what a JSON comparison means over typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of kinds in comparisons across kinds: null, boolean, number, object, array, string. Times stand with numbers.
NULL, BOOLEAN, NUMBER, OBJECT, ARRAY, STRING = range(6)


def rank_of_type(kind: T.DataType) -> int:
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return NUMBER
    if isinstance(kind, (T.StructType, T.MapType)):
        return OBJECT
    if isinstance(kind, T.ArrayType):
        return ARRAY
    return NULL if isinstance(kind, T.NullType) else STRING


def rank_of_value(value: object) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, dict):
        return OBJECT
    return ARRAY if isinstance(value, (list, tuple)) else STRING


def literal(value: object) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*(literal(x) for x in value))
    if isinstance(value, dict):
        return F.struct(*(literal(x).alias(k) for k, x in sorted(value.items())))
    return F.lit(value)


def path(schema: T.StructType, dotted: str) -> tuple[Column, T.DataType]:
    """Column and type of a dotted path through objects. A path that the schema lacks is a null; arrays are not entered."""
    kind: T.DataType = schema
    column = None
    for part in dotted.split("."):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            kind = kind[part].dataType
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        elif isinstance(kind, T.MapType) and column is not None:
            kind, column = kind.valueType, column.getItem(part)
        else:
            return F.lit(None), T.NullType()
    return column, kind


def resolve(df: DataFrame, dotted: str) -> tuple[Column, T.DataType]:
    return path(df.schema, dotted)


def from_json_text(column: Column, dotted: str) -> Column:
    """A path of a raw JSON text, as text; null where missing."""
    return F.get_json_object(column, "$." + dotted)
