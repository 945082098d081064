"""Pipelines, updates, policies, clocks, folds, transactions and routing on small frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import hlc, routing
from larkspur.operators import kv, observe, policy, txn, updates, vectors
from larkspur.operators.find import find, project
from larkspur.plans.pipeline import PipelineError, aggregate
from larkspur.sources import catalog
from larkspur.streaming import streams


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_group_accumulators_keep_their_quirks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", 4), (4, "b", None), (5, None, None)], "_id long, g string, v long")
    spec = {"_id": "$g", "s": {"$sum": "$v"}, "m": {"$avg": "$v"}, "lo": {"$min": "$v"}, "hi": {"$max": "$v"}, "n": {"$count": {}}}
    assert rows(aggregate(df, [{"$group": spec}]), "_id") == [(None, 1.0, 0.0, None, None, 1), ("a", 6.0, 2.5, None, 5, 2), ("b", 5.0, 2.0, 4, 4, 2)]
    assert rows(aggregate(df, [{"$group": spec}], compat=False), "_id")[1] == ("a", 5.0, 5.0, 5, 5, 2)
    assert rows(aggregate(df.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    with pytest.raises(PipelineError):
        aggregate(df, [{"$group": {"_id": 1, "x": {"$sum": 1, "$max": 2}}}])
    with pytest.raises(PipelineError):
        aggregate(df, [{"$facet": {}}])
    assert aggregate(df, [{"$facet": {}}], lenient=True).count() == 5


def test_sort_goes_by_name_and_nulls_are_lowest(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 1, 1), (3, 1, 2)], "_id long, b long, a long")
    assert [r._id for r in find(df, sort={"b": 1, "a": -1}).collect()] == [3, 2, 1]
    assert [r._id for r in find(df, sort=[("b", 1), ("a", 1)]).collect()] == [2, 3, 1]
    assert [r._id for r in find(df, skip=9).collect()] == [] and [r._id for r in find(df, skip=1, limit=1).collect()] == [2]
    nested = spark.createDataFrame([(1, (1, ("x", "y")))], "_id long, o struct<p:long,q:struct<r:string,s:string>>")
    assert rows(project(nested, {"o.q.r": 1})) == [(1, ((("x",)),))] or project(nested, {"o.q.r": 1}).columns == ["_id", "o"]
    assert project(nested, {"o.p": 0}).schema["o"].dataType.fieldNames() == ["q"]


def test_unwind_and_lookup_edges(spark):
    df = spark.createDataFrame([(1, [1, 1, 9]), (2, []), (3, None)], "_id long, ks array<long>")
    assert len(rows(aggregate(df, [{"$unwind": "$ks"}]))) == 3 and len(rows(aggregate(df, [{"$unwind": {"path": "$ks", "preserveNullAndEmptyArrays": True}}]))) == 5
    other = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    spec = {"$lookup": {"from": "o", "localField": "ks", "foreignField": "k", "as": "m"}}
    assert [len(r.m) for r in aggregate(df, [spec], {"o": other}).orderBy("_id").collect()] == [2, 0, 0]
    typed = spark.createDataFrame([(1.0, "x")], "k double, v string")
    assert [len(r.m) for r in aggregate(df, [spec], {"o": typed}).orderBy("_id").collect()] == [0, 0, 0]


def test_updates(spark):
    df = spark.createDataFrame([(1, (1, "a"), ["x"], "t"), (2, None, None, None)], "_id long, o struct<p:long,q:string>, l array<string>, s string")
    out = updates.apply_update(df, {"$set": {"o.p": 5, "s.deep": 1}, "$push": {"l": "y"}, "$inc": {"n": 2}}).orderBy("_id").collect()
    assert out[0].o.p == 5 and out[0].o.q == "a" and out[0].s.deep == 1 and out[0].l == ["x", "y"] and out[1].l == ["y"] and out[0].n == 2.0
    assert updates.apply_update(df, {"$unset": {"o.q": 1, "s": 1}}).columns == ["_id", "o", "l"]
    gone = updates.delete(df.select("_id", F.lit("0").alias("_hlc"), F.lit(False).alias("_tombstone"), F.lit(0).alias("updated_at"), "s"), df.select("_id").limit(1), True, "f", 9)
    assert gone.where("_tombstone").count() == 1


def test_policies_parse_and_deny(spark):
    assert policy.parse("a = 1 OR b = 2 AND NOT c IN ('x', \"y\\\"z\")") == {"$or": [{"a": {"$eq": 1}}, {"$and": [{"b": {"$eq": 2}}, {"$not": {"c": {"$in": ["x", 'y"z']}}}]}]}
    assert policy.parse("owner = current_user()", "ann") == {"owner": {"$eq": "ann"}} and policy.parse("o = $user", "ann") == {"o": {"$eq": "ann"}}
    assert policy.parse("") == {} and policy.parse("a = ") == policy.DENY and policy.parse("a = 1 b") == policy.DENY and policy.parse("a # 1") == policy.DENY
    df = spark.createDataFrame([(1, "ann"), (2, "bob")], "_id long, owner string")
    mine = policy.Policy("mine", using="owner = current_user", roles=["u"])
    assert rows(policy.secure(df, [mine], roles={"u"}, user="bob")) == [(2, "bob")] and rows(policy.secure(df, [mine], roles={"v"})) == [] and policy.secure(df, None).count() == 2
    assert policy.visible([policy.Policy("w", "INSERT", check="a = 1", using="b = 2")], "INSERT", set(), check=True) == {"a": {"$eq": 1}}
    assert policy.closure("a", {"a": ["b"], "b": ["a", "c"]}) == {"a", "b", "c", "public"} and policy.revoke(policy.grant(0, "SELECT", "INSERT"), "SELECT") == 2


def test_clocks_move_forward_and_merges_converge(spark):
    c = hlc.Clock()
    seen = [c.tick(5), c.tick(5), c.tick(3), c.update(f"{9:012x}{7:04x}", 5), c.tick(1)]
    assert seen == sorted(set(seen))
    c.count = 0xFFFF
    assert c.tick(1) == f"{10:012x}0000"
    assert int(hlc.Clock().update(f"{10**9:012x}0000", 0)[:12], 16) == hlc.MAX_DRIFT_MS
    parts = [spark.createDataFrame([(i, random.Random(k * 9 + i).choice("abc"), f"{k}{i}") for i in range(4)], "_id long, _hlc string, v string") for k in range(3)]
    ends = set()
    for order in itertools.permutations(parts):
        state = order[0]
        for p in order[1:]:
            state = hlc.merge(state, p)
        ends.add(tuple(r._hlc for r in state.orderBy("_id").collect()))
    assert len(ends) == 1


def test_folds(spark):
    log = spark.createDataFrame([(1, "k", "set", "5"), (2, "k", "incr", "2"), (3, "k", "set", "x"), (4, "k", "incr", None), (5, "j", "decr", "3"), (6, "h", "set", "1"), (7, "h", "del", None)], "seq long, key string, op string, value string")
    assert rows(kv.counters(log), "key") == [("j", -3), ("k", 1)] and rows(kv.last_set(log)) == [("k", "x")]
    pushes = spark.createDataFrame([(1, "l", "rpush", "a"), (2, "l", "lpush", "b"), (3, "l", "rpush", "c"), (4, "l", "lpop", None)], "seq long, key string, op string, value string")
    assert [r.value for r in kv.list_range(pushes, 0, -1).orderBy("pos").collect()] == ["b", "a", "c"] and [r.value for r in kv.popped(pushes).orderBy("pos").collect()] == ["a", "c"]
    assert [r.value for r in kv.list_range(pushes, -2, 99).orderBy("pos").collect()] == ["a", "c"] and kv.list_range(pushes, 5, 9).count() == 0


def test_transactions_apply_wholly_or_not(spark):
    base = spark.createDataFrame([(1, "a", 1, 0), (2, "b", 4, 0)], "_id long, value string, version int, updated_at int")
    ops = lambda *x: spark.createDataFrame(list(x), "seq long, op string, _id long, value string, expected_version int")
    after, status = txn.execute(base, ops((1, "update", 1, "x", 1), (2, "update", 1, "y", None), (3, "remove", 2, None, 0), (4, "insert", 2, "z", 0)), 7)
    assert status == "COMMITTED" and rows(after.select("_id", "value", "version"), "_id") == [(1, "y", 2), (2, "z", 5)]
    for bad, why in (((1, "insert", 1, "x", 0), "DUPLICATE"), ((1, "update", 9, "x", 0), "NOT_FOUND"), ((1, "update", 2, "x", 3), "CONFLICT")):
        same, status = txn.execute(base, ops(bad), 7)
        assert status == why and same is base
    assert txn.execute(base, ops((1, "update", 1, "b", 0)), 7, unique=["value"])[1] == "DUPLICATE"


def test_routing_and_observability(spark):
    ring = routing.Ring(["a", "b"])
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    got = df.select("k", ring.route(F.col("k")).alias("o")).collect()
    assert all(r.o == ring.owner(r.k) for r in got) and {r.o for r in got} == {"a", "b"}
    moved = routing.moves(df, "k", ring, routing.Ring(["a", "b", "c"])).collect()
    assert moved and all(r.new_owner == "c" for r in moved)
    hits = spark.createDataFrame([("u", t) for t in (0.0, 0.0, 0.0, 2.0)], "u string, t double")
    assert [r.allowed for r in observe.token_bucket(hits, "u", "t", 0.5, 2.0).orderBy("t").collect()] .count(False) == 1


def test_vectors_reject_unknown_metrics(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.search(df, [1.0, 0.0]).collect()] == [1, 2] and vectors.violations(df, 2).count() == 1
    with pytest.raises(ValueError):
        vectors.search(df, [1.0], metric="hamming")


def test_backup_round_trip_and_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k long, v string").withColumn("seq", F.when(F.col("v") == "c", 2).otherwise(1))
    catalog.backup(df, str(tmp_path / "b"), "k", 3, 4)
    back, skipped = catalog.restore(spark, str(tmp_path / "b"), "k long, v string, seq int")
    assert sorted(rows(back)) == sorted(rows(df)) and skipped == 0
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), "k long, v string, seq int")
    streams.upsert_into(stream, str(tmp_path / "out"), "k", "seq", str(tmp_path / "ck")).awaitTermination()
    assert sorted(rows(streams.upserted(spark, str(tmp_path / "out")).select("k", "v", "seq"))) == sorted(rows(streams.latest(df, "k", "seq")))
    df.where("v = 'b'").withColumn("seq", F.lit(9)).write.mode("append").parquet(str(tmp_path / "in"))  # a second batch touches one bucket
    streams.upsert_into(stream, str(tmp_path / "out"), "k", "seq", str(tmp_path / "ck")).awaitTermination()
    assert sorted(rows(streams.upserted(spark, str(tmp_path / "out")).select("k", "v", "seq"))) == [(1, "c", 2), (2, "b", 9)]
    names = catalog.Catalog()
    names.create("t", df)
    assert names.collections() == [("default", "public", "t")] and names.databases() == {"default": 1}


def test_search_many_goes_through_queries_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r.vec_id) for r in vectors.search_many(df, asked, 3, "dot", most=5).collect()}
    best = lambda q: sorted((-sum(x * y for x, y in zip(q, v)), i) for i, v in rows)[:3]
    assert got == {(i, j) for i, q in rows if i % 100 == 0 for _, j in best(q)}


def test_routes_are_those_of_the_formula(spark):
    mask = (1 << 64) - 1

    def place(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    shards = ["s0", "s1", "s2"]
    spots = sorted((place(f"{s}#{v}"), s) for s in shards for v in range(256))
    owner = lambda k: next((s for p, s in spots if p >= place(k)), spots[0][1])
    keys = [f"item-{i}" for i in range(300)] + ["", "é", "a" * 200]
    ring = routing.Ring([*shards, ""])
    assert [ring.owner(k) for k in keys] == [owner(k) for k in keys]
    assert len(routing.Ring(["a"], 3).points) == routing.LEAST_VNODES
    with pytest.raises(ValueError):
        routing.Ring([])


def test_guards_refuse_and_registries_keep_their_dimension(spark, tmp_path):
    df = spark.createDataFrame([(1, "ann"), (2, "bob")], "_id long, owner string")
    mine = policy.Guard({"u"}, [{"role": "u", "target": {"type": "collection", "name": "t"}, "privileges": policy.grant(0, "SELECT", "INSERT")}], {"t": [policy.Policy("mine", using="owner = current_user")]}, "ann")
    assert rows(mine.rows(df, "t")) == [(1, "ann")] and mine.written(df.where("_id = 1"), "t").count() == 1
    for call in (lambda: mine.rows(df, "t", "DELETE"), lambda: mine.rows(df, "other"), lambda: mine.written(df, "t")):
        with pytest.raises(PermissionError):
            call()
    held = vectors.Registry()
    name, v = ("d", "s", "c"), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    held.insert(name, v)
    assert held.insert(name, v.where("vec_id = 2").withColumn("vec_id", F.lit(3).cast("long"))).count() == 3
    with pytest.raises(ValueError):
        held.insert(name, spark.createDataFrame([(4, [1.0])], v.schema))
    held.save(name, str(tmp_path / "v"))
    assert vectors.Registry().load(spark, name, str(tmp_path / "v")).count() == 3


def test_lists_replay_pops_between_pushes(spark):
    ops = [(1, "k", "rpush", "a"), (2, "k", "lpop", None), (3, "k", "lpop", None), (4, "k", "lpush", "b"), (5, "k", "rpush", "c"), (6, "k", "rpop", None), (7, "j", "rpush", "d"), (8, "j", "del", None), (9, "j", "lpush", "e")]
    log = spark.createDataFrame(ops, "seq long, key string, op string, value string")
    assert rows(kv.replayed_lists(log), "key") == [("j", 0, "e"), ("k", 0, "b")]


def test_lru_keeps_within_bytes(spark):
    log = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10), (4, "a", 15)], "seq long, key string, mem_bytes long")
    assert rows(kv.lru(log, 9, most_bytes=25, shard=F.lit(0)).select("key"), "key") == [("a",), ("c",)]


def random_log(spark, n=3000):
    """An operation log, and what its keys' containers hold by plain Python: key -> container -> entries with their bytes."""
    r, log, held = random.Random(5), [], {}
    for seq in range(n):
        row = dict(seq=seq, key=r.randrange(40), op=r.choice(["set", "del", "hset", "hdel", "lpush", "rpush", "sadd", "srem", "zadd", "zrem", "get"]), field=str(r.randrange(3)), value=r.choice(["", "é", "abc", "12345"]), score=r.random())
        log.append(row)
        mine, size = held.setdefault(row["key"], {}), len(row["value"].encode())
        where, entry, takes = {"s": ("kv", "", size), "h": ("hash", row["field"], size + 1), "l": ("list", seq, size), "r": ("list", seq, size)}.get(row["op"][0], ("", "", 0))
        where, entry, takes = {"sadd": ("set", row["value"], size), "srem": ("set", row["value"], size), "zadd": ("zset", row["value"], size + 8), "zrem": ("zset", row["value"], size + 8)}.get(row["op"], (where, entry, takes))
        if row["op"] == "del":
            mine.clear()
        elif row["op"] in ("hdel", "srem", "zrem"):
            mine.get(where, {}).pop(entry, None)
        elif where:
            mine.setdefault(where, {})[entry] = takes
    return spark.createDataFrame(log, "seq long, key long, op string, field string, value string, score double"), held


def joins_of(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join "), plan.count("Union")


def test_bytes_of_all_containers_come_from_one_pass(spark):
    log, held = random_log(spark)
    want = {k: sum(len(str(k)) + sum(x.values()) for x in mine.values() if x) for k, mine in held.items() if any(mine.values())}
    out = kv.footprint(log)
    assert {r.key: r.mem_bytes for r in out.collect()} == want and len(want) > 30
    assert joins_of(out) == (1, 0)  # a task had the sorts and tables of five containers before


def test_keys_exist_by_one_pass(spark):
    log, held = random_log(spark)
    out = kv.exists(log)
    assert {r.key for r in out.collect()} == {k for k, mine in held.items() if any(mine.values())} and joins_of(out) == (1, 0)
    odd = spark.createDataFrame([(1, None, "sadd", None), (2, None, "del", None), (3, "a", "set", None), (4, "b", "sadd", "x"), (5, "b", "srem", "x"), (6, "c", "rpush", None), (7, "c", "del", None)], "seq long, key string, op string, value string").withColumn("field", F.lit(None).cast("string"))
    assert rows(kv.footprint(odd), "key") == [(None, None), ("a", None)]  # no key equals a null one, so its members outlive the del; unknown sizes stay unknown
