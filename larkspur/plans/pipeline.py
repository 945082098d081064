"""Aggregation pipelines compiled stage by stage to DataFrame plans.

Two rewrites happen before Catalyst sees the plan: $lookup and $unwind of its result become an inner or left join, and
$lookup followed by a match on an empty (or not empty) result becomes an anti (or semi) join.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.filters import match
from larkspur.operators.find import included, include_tree, order_of
from larkspur.types import ARRAY, NULL, NUMBER, path, rank_of_type

STAGES = ("$match", "$group", "$sort", "$limit", "$skip", "$project", "$unwind", "$lookup")
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$count")


class PipelineError(ValueError):
    pass


def aggregate(df: DataFrame, stages: list[dict], collections: dict[str, DataFrame] | None = None, order: str | list[str] | None = None, lenient: bool = False, compat: bool = True) -> DataFrame:
    """Run the stages over df. order names the columns that give rows their natural order.

    lenient skips what is malformed instead of raising. compat=False gives $sum, $avg, $min and $max their usual
    meaning; otherwise non-numbers add one to a $sum and count in an $avg, and the first value seeds $min and $max.
    """
    state = [order] if isinstance(order, str) else list(order or ([c for c in ("_id",) if c in df.columns]))
    grouped = ordered = False
    k = 0
    while k < len(stages):
        name = next((s for s in STAGES if s in stages[k]), None) if isinstance(stages[k], dict) else None
        if name is None:
            if not lenient:
                raise PipelineError(f"unknown stage {stages[k]!r}")
            k += 1
            continue
        spec = stages[k][name]
        if name == "$match":
            df = match(df, spec)
        elif name == "$group":
            df, state, grouped, ordered = group(df, spec, state, lenient, compat), ["_id"], True, False
        elif name == "$sort":
            df, ordered = df.orderBy(*order_of(df, spec, None), *natural(df, state, grouped)), True
        elif name in ("$limit", "$skip"):
            by = natural(df, state, grouped)
            df, ordered = df if ordered or not by else df.orderBy(*by), True
            df = df.limit(int(spec)) if name == "$limit" else df.offset(int(spec))
        elif name == "$project":
            df = project_stage(df, spec)
        elif name == "$unwind":
            df = unwind(df, spec)
        else:
            needed = {"from", "localField", "foreignField", "as"}
            if not isinstance(spec, dict) or not needed <= set(spec) or spec["from"] not in (collections or {}):
                if not lenient:
                    raise PipelineError(f"$lookup needs {sorted(needed)} and a known collection")
            else:
                df, used = lookup_rewritten(df, spec, collections[spec["from"]], stages[k + 1 :])
                k += used
        k += 1
    return df


def natural(df: DataFrame, state: list[str], grouped: bool) -> list[Column]:
    """Order of rows that nobody has sorted: that of their keys; of groups, that of their keys as they are written in JSON."""
    if not grouped:
        return [F.col(c).asc_nulls_first() for c in state if c in df.columns]
    if "_id" not in df.columns:
        return []
    kind = df.schema["_id"].dataType
    text = F.concat(F.lit('"'), "_id", F.lit('"')) if isinstance(kind, T.StringType) else F.col("_id").cast("string") if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.to_json("_id")
    return [F.coalesce(text, F.lit("null"))]


def argument(df: DataFrame, arg: object) -> tuple[Column, T.DataType]:
    if isinstance(arg, str) and arg.startswith("$"):
        return path(df.schema, arg[1:])
    c = F.lit(arg) if not isinstance(arg, (dict, list)) else F.lit(None)
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return c, kinds.get(type(arg), T.NullType())


def accumulator(df: DataFrame, op: str, arg: object, state: list[str], compat: bool) -> Column:
    if op == "$count":
        return F.count(F.lit(1))
    c, kind = argument(df, arg)
    rank, number = rank_of_type(kind), c.try_cast("double") if rank_of_type(kind) == NUMBER else F.lit(None).cast("double")
    if op == "$sum":
        return F.sum(F.coalesce(number, F.lit(1.0 if compat else 0.0)))
    if op == "$avg":
        return F.sum(F.coalesce(number, F.lit(0.0))) / F.count(F.lit(1)) if compat else F.avg(number)
    low = op == "$min"
    best = (F.min if low else F.max)(c)
    if not compat or not state:
        return best
    if rank == NUMBER:  # a null that comes first stays the minimum; a maximum forgets it
        if not low:
            return best
        first = F.min_by(F.struct(c.alias("v")), F.struct(*(F.col(x) for x in state)))
        return F.when(first["v"].isNotNull(), best)
    return F.min_by(F.struct(c.alias("v")), F.struct(*(F.col(x) for x in state)))["v"]


def group(df: DataFrame, spec: dict, state: list[str], lenient: bool, compat: bool) -> DataFrame:
    """One row a key, null keys included; a key that is no field name makes one group, and no rows make no group."""
    key = spec.get("_id")
    k = path(df.schema, key.removeprefix("$"))[0] if isinstance(key, str) else F.lit(None).cast("string")
    if isinstance(key, str) and rank_of_type(path(df.schema, key.removeprefix("$"))[1]) == NULL:
        k = F.lit(None).cast("string")
    aggs = []
    for out, acc in spec.items():
        if out == "_id":
            continue
        ops = [o for o in acc if o in ACCUMULATORS] if isinstance(acc, dict) else []
        if len(ops) != 1 or len(acc) != 1:
            if lenient and not ops:
                continue
            raise PipelineError(f"{out} needs one accumulator of {ACCUMULATORS}")
        aggs.append(accumulator(df, ops[0], acc[ops[0]], state, compat).alias(out))
    grouped = df.groupBy(k.alias("_id"))
    return grouped.agg(*aggs) if aggs else df.select(k.alias("_id")).distinct()


def project_stage(df: DataFrame, spec: dict) -> DataFrame:
    renames = {k: v[1:] for k, v in spec.items() if isinstance(v, str) and v.startswith("$")}
    keep = [k for k, v in spec.items() if v == 1 and not isinstance(v, str)]
    if not renames and not keep:
        for field in (k for k, v in spec.items() if v == 0):
            top, _, rest = field.partition(".")
            if top in df.columns:
                df = df.withColumn(top, F.col(f"`{top}`").dropFields(rest)) if rest else df.drop(top)
        return df
    if "_id" in df.columns and spec.get("_id") != 0 and "_id" not in keep and "_id" not in renames:
        keep = ["_id", *keep]
    columns = included(df.schema, include_tree(keep))
    nested: dict[str, list[Column]] = {}
    for new, old in renames.items():
        top, _, rest = new.partition(".")
        c = path(df.schema, old)[0]
        if rest:
            nested.setdefault(top, []).append(c.alias(rest))
        else:
            columns.append(c.alias(new))
    return df.select(*columns, *(F.struct(*cs).alias(top) for top, cs in nested.items()))


def unwind(df: DataFrame, spec: str | dict) -> DataFrame:
    """One row an element. Kept empty and null arrays give a null element, as a typed column cannot hold both."""
    keep = isinstance(spec, dict) and bool(spec.get("preserveNullAndEmptyArrays"))
    name = (spec["path"] if isinstance(spec, dict) else spec).removeprefix("$")
    c, kind = path(df.schema, name)
    top, _, rest = name.partition(".")
    if rank_of_type(kind) == NULL:
        return df if keep else df.limit(0)
    if rank_of_type(kind) != ARRAY:
        return df if keep else df.filter(c.isNotNull())
    if not rest:
        each = (F.explode_outer if keep else F.explode)(c).alias(name)
        return df.select(*(each if x == name else F.col(f"`{x}`") for x in df.columns))
    each = (F.explode_outer if keep else F.explode)(c).alias("_each")
    return df.select("*", each).withColumn(top, F.col(f"`{top}`").withField(rest, F.col("_each"))).drop("_each")


def keys_of(df: DataFrame, field: str, alias: str) -> tuple[DataFrame, T.DataType]:
    """df with one row for each key of the field: an array has each of its elements, duplicates too."""
    c, kind = path(df.schema, field)
    if isinstance(kind, T.ArrayType):
        return df.withColumn(alias, F.explode(c)), kind.elementType
    return df.withColumn(alias, c), kind


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Keys match by their written form: whole numbers and fractions never do, nor do numbers and strings."""
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if isinstance(a, whole) or isinstance(b, whole):
        return isinstance(a, whole) and isinstance(b, whole)
    return rank_of_type(a) == rank_of_type(b)


def lookup(df: DataFrame, spec: dict, foreign: DataFrame) -> DataFrame:
    """Left outer equi-join whose matches are gathered into an array, ordered; null keys never match."""
    name = spec["as"]
    right, kind_r = keys_of(foreign.select("*", F.struct(*(F.col(f"`{c}`") for c in foreign.columns)).alias("_doc")), spec["foreignField"], "_fk")
    empty = F.array().cast(T.ArrayType(foreign.schema))
    c, kind_l = path(df.schema, spec["localField"])
    many = isinstance(kind_l, T.ArrayType)
    kind_k = kind_l.elementType if many else kind_l
    base = df.drop(name)
    if not comparable(kind_k, kind_r):
        return base.withColumn(name, empty)
    right = right.filter(F.col("_fk").isNotNull())
    if isinstance(path(foreign.schema, spec["foreignField"])[1], T.ArrayType):
        right = right.dropDuplicates([*[c for c in foreign.columns if not isinstance(foreign.schema[c].dataType, (T.MapType,))], "_fk"])
    if not many:  # gather the foreign side once, then join
        grouped = right.groupBy("_fk").agg(F.array_sort(F.collect_list("_doc")).alias("_found"))
        out = base.withColumn("_lk", c).join(grouped, F.col("_lk") == F.col("_fk"), "left")
        return out.withColumn(name, F.coalesce("_found", empty)).drop("_lk", "_fk", "_found")
    row = F.xxhash64(*(F.col(f"`{x}`") for x in base.columns))
    order = base.withColumn("_row", F.struct(row, F.to_json(F.struct(*(F.col(f"`{x}`") for x in base.columns)))))
    each = order.select("_row", F.posexplode(c).alias("_pos", "_lk"))
    found = each.distinct().join(right.select("_fk", "_doc"), F.col("_lk") == F.col("_fk")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_doc"))).alias("_found"))
    out = order.join(found, "_row", "left").withColumn(name, F.coalesce(F.transform("_found", lambda x: x["_doc"]), empty))
    return out.drop("_row", "_found")


def unused(name: str, later: list[dict]) -> bool:
    """Whether no later stage reads or returns the field, so that nobody sees what it holds."""
    for stage in later:
        if re.search(r'"\$?' + re.escape(name) + r'[".]', json.dumps(stage, default=str)):
            return False
        if "$group" in stage or any(v == 1 or (isinstance(v, str) and v.startswith("$")) for v in stage.get("$project", {}).values()):
            return True
    return False


def lookup_rewritten(df: DataFrame, spec: dict, foreign: DataFrame, later: list[dict]) -> tuple[DataFrame, int]:
    """The lookup, joined at once with the stage after it where that stage allows it; how many stages that took."""
    name, after = spec["as"], later[0] if later else {}
    c, kind_l = path(df.schema, spec["localField"])
    f, kind_r = path(foreign.schema, spec["foreignField"])
    plain = not isinstance(kind_l, T.ArrayType) and not isinstance(kind_r, T.ArrayType) and comparable(kind_l, kind_r)
    if plain and after.get("$unwind") is not None:
        u = after["$unwind"]
        where, keep = (u.get("path"), bool(u.get("preserveNullAndEmptyArrays"))) if isinstance(u, dict) else (u, False)
        if where in (f"${name}", name):
            right = foreign.select(f.alias("_fk"), F.struct(*(F.col(f"`{x}`") for x in foreign.columns)).alias(name))
            return df.drop(name).withColumn("_lk", c).join(right, F.col("_lk") == F.col("_fk"), "left" if keep else "inner").drop("_lk", "_fk"), 1
    if plain and after.get("$match") in ({name: []}, {name: {"$eq": []}}, {name: {"$ne": []}}):
        want = "left_semi" if after["$match"] == {name: {"$ne": []}} else "left_anti"
        if want == "left_anti" or unused(name, later[1:]):
            right = foreign.select(f.alias("_fk"))
            out = df.drop(name).withColumn("_lk", c).join(right, F.col("_lk") == F.col("_fk"), want).drop("_lk")
            return out.withColumn(name, F.array().cast(T.ArrayType(foreign.schema))), 1
    return lookup(df, spec, foreign), 0


