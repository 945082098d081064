"""Update documents compiled to column expressions. Operators run in the order of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.types import ARRAY, NUMBER, literal, path, rank_of_type

OPERATORS = ("addToSet", "inc", "mul", "pull", "push", "rename", "set", "unset")


def put(df: DataFrame, dotted: str, value: Column) -> DataFrame:
    """Set a path, making or replacing what is in its way."""
    top, _, rest = dotted.partition(".")
    if not rest:
        return df.withColumn(top, value)
    return df.withColumn(top, nest(F.col(f"`{top}`"), df.schema[top].dataType if top in df.columns else None, rest, value))


def nest(c: Column, kind: T.DataType | None, rest: str, value: Column) -> Column:
    name, _, below = rest.partition(".")
    if not isinstance(kind, T.StructType):
        return F.struct((nest(c, None, below, value) if below else value).alias(name))
    fields = [c.getField(f).alias(f) for f in kind.fieldNames() if f != name]
    inner = kind[name].dataType if name in kind.fieldNames() else None
    return F.struct(*fields, (nest(c.getField(name), inner, below, value) if below else value).alias(name))


def remove(df: DataFrame, dotted: str) -> DataFrame:
    top, _, rest = dotted.partition(".")
    if top not in df.columns:
        return df
    return df.withColumn(top, F.col(f"`{top}`").dropFields(rest)) if rest else df.drop(top)


def apply_update(df: DataFrame, update: dict, guard: Column | None = None) -> DataFrame:
    """df with the update applied to every row, or to those where guard holds. Keys go with or without $; a key that is no operator sets that field."""
    named = {k.removeprefix("$"): v for k, v in update.items()}
    for op in sorted(named, key=lambda k: "$" + k):
        spec = named[op]
        if op not in OPERATORS or not isinstance(spec, (dict, list)):
            df = _set(df, op, literal(spec), guard)
        elif op == "unset":
            for f in spec:
                df = remove(df, f) if guard is None else _set(df, f, F.lit(None), guard)
        else:
            for f, v in spec.items():
                c, kind = path(df.schema, f)
                if op == "rename":
                    if rank_of_type(kind) != 0:
                        df = remove(_set(df, v, c, guard), f)
                else:
                    df = _set(df, f, changed(op, c, kind, v), guard)
    return df


def _set(df: DataFrame, field: str, value: Column, guard: Column | None) -> DataFrame:
    c, kind = path(df.schema, field)
    return put(df, field, value if guard is None else F.when(guard, value).otherwise(c))


def changed(op: str, c: Column, kind: T.DataType, v: object) -> Column:
    if op == "set":
        return literal(v)
    if op in ("inc", "mul"):
        base = F.coalesce(c.cast("double"), F.lit(0.0)) if rank_of_type(kind) == NUMBER else F.lit(0.0)
        return base + F.lit(float(v)) if op == "inc" else base * F.lit(float(v))
    array = rank_of_type(kind) == ARRAY
    item = literal(v).cast(kind.elementType) if array else literal(v)
    if op == "push":
        return F.array_append(F.coalesce(c, F.array().cast(kind)), item) if array else F.array(item)
    if op == "pull":
        return F.filter(c, lambda x: ~x.eqNullSafe(item)) if array else c
    if not array:  # addToSet
        return F.array(item)
    return F.when(F.exists(F.coalesce(c, F.array().cast(kind)), lambda x: x.eqNullSafe(item)), c).otherwise(F.array_append(F.coalesce(c, F.array().cast(kind)), item))


def update_versioned(df: DataFrame, update: dict, now_ms: int, ids: list | None = None, expected_version: int = 0) -> DataFrame:
    """Envelope rows (_id, version, updated_at, fields) with a status column: UPDATED, CONFLICT or UNCHANGED; _id never changes."""
    mine = F.col("_id").isin(ids) if ids is not None else F.lit(True)
    fits = F.lit(True) if not expected_version else F.col("version") == expected_version
    update = {op: ({f: v for f, v in spec.items() if f != "_id"} if isinstance(spec, dict) else spec) for op, spec in update.items() if op != "_id"}
    tagged = df.withColumn("status", F.when(mine & fits, "UPDATED").when(mine, "CONFLICT").otherwise("UNCHANGED"))
    hit = F.col("status") == "UPDATED"
    out = apply_update(tagged, update, hit)
    return out.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version"))).withColumn("updated_at", F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_at")))


def delete(df: DataFrame, ids: DataFrame, tombstones: bool = False, hlc: str | None = None, now_ms: int = 0) -> DataFrame:
    """Rows without those of ids, or with tombstones in their place; deleting a tombstone again changes nothing."""
    if not tombstones:
        return df.join(ids, "_id", "left_anti")
    dead = df.join(ids.withColumn("_hit", F.lit(True)).distinct(), "_id", "left")
    hit = F.col("_hit") & ~F.coalesce(F.col("_tombstone"), F.lit(False))
    fields = [c for c in df.columns if c not in ("_id", "_hlc", "_tombstone", "updated_at")]
    values = [F.when(hit, F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in fields]
    return dead.select("_id", *values, F.when(hit, F.lit(hlc)).otherwise(F.col("_hlc")).alias("_hlc"), F.coalesce(hit, F.lit(False)) | F.coalesce("_tombstone", F.lit(False)), F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at")).toDF("_id", *fields, "_hlc", "_tombstone", "updated_at")
