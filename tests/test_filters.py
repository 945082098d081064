"""Compiled filters against a plain interpreter of the same rules, over nullable columns of several kinds."""

import itertools

import pytest

from larkspur.operators.filters import FilterError, compile_filter
from larkspur.types import rank_of_value

ROWS = [(1, 2.0, "b", True, [1, 2], ("x", 1)), (2, None, None, None, None, None), (3, -1.0, "", False, [], ("y", None)), (4, 7.5, "abc", True, [2, 2, None], (None, 3))]
SCHEMA = "i long, d double, s string, b boolean, a array<long>, o struct<n:string,k:long>"
LITERALS = [None, True, False, 2, 7.5, -3, "b", "", "zz"]


def value(row, field):
    v = row
    for part in field.split("."):
        v = v.get(part) if isinstance(v, dict) else None
    return v


def less(a, b):
    ra, rb = rank_of_value(a), rank_of_value(b)
    return ra < rb if ra != rb else (a is not None and a < b)


def same(a, b):
    return rank_of_value(a) == rank_of_value(b) and a == b


def holds(row, field, op, v):
    x = value(row, field)
    return {"$eq": lambda: same(x, v), "$ne": lambda: not same(x, v), "$gt": lambda: less(v, x), "$gte": lambda: not less(x, v), "$lt": lambda: less(x, v), "$lte": lambda: not less(v, x), "$in": lambda: any(same(x, y) for y in [v, 2]), "$nin": lambda: not any(same(x, y) for y in [v, 2])}[op]()


def test_scalars_match_the_model(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = [{"i": r[0], "d": r[1], "s": r[2], "b": r[3], "o": None if r[5] is None else {"n": r[5][0], "k": r[5][1]}} for r in ROWS]
    cases = list(itertools.product(["i", "d", "s", "b", "o.n", "o.k", "missing", "s.deep"], ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"], LITERALS))
    specs = [{f: {op: [v, 2] if op in ("$in", "$nin") else v}} for f, op, v in cases]
    got = df.select(*(compile_filter(df.schema, s).alias(f"c{k}") for k, s in enumerate(specs))).collect()
    for k, (f, op, v) in enumerate(cases):
        assert [r[f"c{k}"] for r in got] == [holds(m, f, op, v) for m in model], (f, op, v)


def ids(df, spec):
    return [r.i for r in df.filter(compile_filter(df.schema, spec)).orderBy("i").collect()]


def test_arrays_objects_and_combinators(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert ids(df, {"a": [1, 2]}) == [1] and ids(df, {"a": []}) == [3] and ids(df, {"a": {"$contains": 2}}) == [1, 4]
    assert ids(df, {"a": {"$contains": None}}) == [4] and ids(df, {"a": 1}) == []
    assert ids(df, {"o": {"n": "x", "k": 1}}) == [1] and ids(df, {"s": {"$regex": "b"}}) == [1, 4] and ids(df, {"s": {"$regex": "("}}) == []
    assert ids(df, {"s": {"$exists": False}}) == [2] and ids(df, {"d": {"$regex": "1"}}) == [] and ids(df, {"s": {"$contains": "b"}}) == [1, 4]
    assert ids(df, {}) == ids(df, None) == [1, 2, 3, 4] and ids(df, 5) == []
    assert ids(df, {"$or": []}) == [] and ids(df, {"$nor": []}) == [1, 2, 3, 4] and ids(df, {"$and": [{"d": {"$gt": 0}}, {"b": True}]}) == [1, 4]
    assert ids(df, {"$not": {"d": {"$lt": 0}}}) == [1, 4] and ids(df, {"d": {"$near": 1}}) == []
    for bad in ({"s": {"$exists": 1}}, {"s": {"$regex": 2}}, {"s": {"$in": 2}}, {"$or": {}}):
        with pytest.raises(FilterError):
            compile_filter(df.schema, bad)
