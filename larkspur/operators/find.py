"""find, count and projections over a collection held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.filters import match
from larkspur.types import path

DEFAULT_LIMIT = 100


def live(df: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Rows that are no tombstones and, if now_ms is given, not expired: a ttl of 0 never expires, the last instant still lives."""
    if "_tombstone" in df.columns:
        df = df.filter(~F.coalesce(F.col("_tombstone"), F.lit(False)))
    if now_ms is not None and {"ttl", "created_at"} <= set(df.columns):
        df = df.filter((F.coalesce("ttl", F.lit(0)) <= 0) | (F.lit(now_ms) <= F.col("created_at") + F.col("ttl").cast("long") * 1000))
    return df


def order_of(df: DataFrame, sort: dict | list, key: str | None = "_id") -> list[Column]:
    """Sort columns. A mapping goes by field name, a list of pairs as given; nulls are lowest; ties go by key."""
    pairs = sorted(sort.items()) if isinstance(sort, dict) else list(sort)
    out = []
    for field, direction in pairs:
        c, _ = path(df.schema, field)
        out.append(c.asc_nulls_first() if direction > 0 else c.desc_nulls_last())
    if key in df.columns and key not in [f for f, _ in pairs]:
        out.append(F.col(key).asc_nulls_first())
    return out


def include_tree(fields: list[str]) -> dict:
    tree: dict = {}
    for f in fields:
        node = tree
        for part in f.split("."):
            node = node.setdefault(part, {})
    return tree


def included(schema: T.StructType, tree: dict, parent: Column | None = None) -> list[Column]:
    out = []
    for name, sub in tree.items():
        if name not in schema.fieldNames():
            continue
        c = F.col(f"`{name}`") if parent is None else parent.getField(name)
        kind = schema[name].dataType
        if sub and isinstance(kind, T.StructType):
            c = F.when(c.isNotNull(), F.struct(*included(kind, sub, c)))
        out.append(c.alias(name))
    return out


def project(df: DataFrame, spec: dict | None, key: str = "_id") -> DataFrame:
    """Any 1 makes it an inclusion, in which key always stays; otherwise the fields at 0 go."""
    if not spec:
        return df
    if any(v == 1 for v in spec.values()):
        names = [k for k, v in spec.items() if v == 1]
        return df.select(*included(df.schema, include_tree([key, *(n for n in names if n != key)])))
    for field in (k for k, v in spec.items() if v == 0):
        top, _, rest = field.partition(".")
        if top in df.columns:
            df = df.withColumn(top, F.col(f"`{top}`").dropFields(rest)) if rest else df.drop(top)
    return df


def find(df: DataFrame, spec: dict | None = None, sort: dict | list | None = None, skip: int = 0, limit: int | None = DEFAULT_LIMIT, projection: dict | None = None, key: str = "_id", now_ms: int | None = None) -> DataFrame:
    """filter, sort, skip and limit, project; without a sort the order is that of key."""
    out = match(live(df, now_ms), spec)
    order = order_of(out, sort or {}, key)
    if order and (sort or skip or limit is not None):
        out = out.orderBy(*order)
    out = out.offset(skip) if skip else out
    out = out.limit(limit) if limit is not None else out
    return project(out, projection, key)


def count(df: DataFrame, spec: dict | None = None) -> int:
    """Matching rows; expired ones count, tombstones do not."""
    return match(live(df), spec).count()


def found_total(df: DataFrame, spec: dict | None = None, now_ms: int | None = None) -> DataFrame:
    return match(live(df, now_ms), spec).agg(F.count("*").alias("total"))
