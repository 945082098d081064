"""Filter documents compiled to two-valued Columns.

Every compiled predicate is true or false, never null, so that negation means what it says. Missing and null are the
same and rank below all else. Kinds that cannot be equal or ordered by value are folded to constants by rank.
"""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.types import ARRAY, NULL, STRING, literal, path, rank_of_type, rank_of_value

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$contains")
TRUE, FALSE = True, False


class FilterError(ValueError):
    pass


def compile_filter(schema: T.StructType, spec: dict | None) -> Column:
    """Column for a filter document. None and {} match everything; anything else that is no object matches nothing."""
    if spec is None or spec == {}:
        return F.lit(TRUE)
    if not isinstance(spec, dict):
        return F.lit(FALSE)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list):
                raise FilterError(f"{key} needs a list")
            children = [compile_filter(schema, v) for v in value]
            if key == "$and":
                parts += children
            else:
                some = reduce(lambda a, b: a | b, children) if children else F.lit(FALSE)
                parts.append(some if key == "$or" else ~some)
        elif key == "$not":
            parts.append(~compile_filter(schema, value))
        else:
            column, kind = path(schema, key)
            parts.append(condition(column, kind, value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(TRUE)


def condition(c: Column, kind: T.DataType, spec: object) -> Column:
    if not isinstance(spec, dict) or not spec or not any(str(k).startswith("$") for k in spec):
        return equals(c, kind, spec)
    parts = []
    for op, v in spec.items():
        if op not in OPERATORS:  # an unknown operator compares the field with the whole object
            return equals(c, kind, spec)
        parts.append(one(c, kind, op, v))
    return reduce(lambda a, b: a & b, parts)


def equals(c: Column, kind: T.DataType, v: object) -> Column:
    if v is None:
        return c.isNull()
    if rank_of_type(kind) != rank_of_value(v) and not _is_time(kind, v):
        return F.lit(FALSE)
    if isinstance(v, dict):
        if not isinstance(kind, T.StructType) or sorted(kind.fieldNames()) != sorted(v):
            return F.lit(FALSE)
        return c.isNotNull() & reduce(lambda a, b: a & b, (equals(c.getField(k), kind[k].dataType, x) for k, x in v.items()), F.lit(TRUE))
    if isinstance(v, (list, tuple)):
        same = F.size(c) == len(v)
        inner = [equals(F.get(c, F.lit(i)), kind.elementType, x) for i, x in enumerate(v)]
        return F.coalesce(reduce(lambda a, b: a & b, inner, same), F.lit(FALSE))
    return c.eqNullSafe(literal(v))


def valid_pattern(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it."""
    jvm = getattr(SparkContext._active_spark_context, "_jvm", None)
    try:
        jvm.java.util.regex.Pattern.compile(pattern) if jvm else re.compile(pattern)
    except (PySparkException, Py4JJavaError, re.error):
        return False
    return True


def _is_time(kind: T.DataType, v: object) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(v, str)


def ordered(c: Column, kind: T.DataType, op: str, v: object) -> Column:
    """One of > >= < <= by rank first, by value within a rank."""
    up = op in ("$gt", "$gte")
    if v is None:
        return {"$gt": c.isNotNull(), "$gte": F.lit(TRUE), "$lt": F.lit(FALSE), "$lte": c.isNull()}[op]
    mine, other = rank_of_type(kind), rank_of_value(v)
    if mine == NULL:
        return F.lit(not up)
    if mine != other and not _is_time(kind, v):
        if mine > other:
            return c.isNotNull() if up else c.isNull()
        return F.lit(not up)
    x = literal(v)
    value = {"$gt": c > x, "$gte": c >= x, "$lt": c < x, "$lte": c <= x}[op]
    return F.coalesce(value, F.lit(FALSE)) if up else c.isNull() | F.coalesce(value, F.lit(FALSE))


def one(c: Column, kind: T.DataType, op: str, v: object) -> Column:
    if op == "$eq":
        return equals(c, kind, v)
    if op == "$ne":
        return ~equals(c, kind, v)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return ordered(c, kind, op, v)
    if op in ("$in", "$nin"):
        if not isinstance(v, (list, tuple)):
            raise FilterError(f"{op} needs a list")
        plain = [x for x in v if x is not None and rank_of_type(kind) == rank_of_value(x) and not isinstance(x, (dict, list, tuple))]
        rest = [x for x in v if x is None or isinstance(x, (dict, list, tuple))]
        parts = [equals(c, kind, x) for x in rest] + ([F.coalesce(c.isin(plain), F.lit(FALSE))] if plain else [])
        some = reduce(lambda a, b: a | b, parts) if parts else F.lit(FALSE)
        return some if op == "$in" else ~some
    if op == "$exists":
        if not isinstance(v, bool):
            raise FilterError("$exists needs true or false")
        return c.isNotNull() if v else c.isNull()
    if op == "$regex":
        if not isinstance(v, str):
            raise FilterError("$regex needs a string")
        if not valid_pattern(v):
            return F.lit(FALSE)
        return F.coalesce(c.rlike(v), F.lit(FALSE)) if rank_of_type(kind) == STRING else F.lit(FALSE)
    rank = rank_of_type(kind)  # $contains
    if rank == ARRAY:
        return F.coalesce(F.exists(c, lambda x: equals(x, kind.elementType, v)), F.lit(FALSE))
    if rank == STRING and isinstance(v, str):
        return F.coalesce(F.contains(c, F.lit(v)), F.lit(FALSE))
    return F.lit(FALSE)


def match(df: DataFrame, spec: dict | None) -> DataFrame:
    return df.filter(compile_filter(df.schema, spec))
