"""Key/value structures as folds of an operation log: (seq, key, op, field, value, score, ttl, ts)."""

from __future__ import annotations

import re
from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Operations that bring a key into being, whatever it holds.
MAKES = ("set", "incr", "decr", "hset", "lpush", "rpush", "sadd", "zadd")
#: Containers by what their bytes are counted from, and the operations that put into them or take out.
HOLDS = {"kv": ("set", "del"), "hash": ("hset", "hdel"), "list": ("lpush", "rpush"), "set": ("sadd", "srem"), "zset": ("zadd", "zrem")}


def since_del(log: DataFrame) -> DataFrame:
    """The operations of each key after its last del, which takes the key out of every container."""
    gone = log.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("_gone"))
    return log.join(gone, "key", "left").where("_gone IS NULL OR seq > _gone").drop("_gone")


def last_set(log: DataFrame) -> DataFrame:
    """key, value of keys whose last set or del is a set."""
    last = log.where(F.col("op").isin("set", "del")).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'set'").select("key", F.col("last.value").alias("value"))


def counters(log: DataFrame) -> DataFrame:
    """key, value: the last set (a non-number counts as 0, del as 0) and the increments after it."""
    base = log.where(F.col("op").isin("set", "del")).groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("base"))
    start = F.when(F.col("base.op") == "set", F.coalesce(F.expr("try_cast(base.value AS BIGINT)"), F.lit(0))).otherwise(F.lit(0))
    steps = log.where(F.col("op").isin("incr", "decr")).join(base.select("key", F.col("base.seq").alias("since")), "key", "left").where("since IS NULL OR seq > since")
    step = F.coalesce(F.expr("try_cast(value AS BIGINT)"), F.lit(1)) * F.when(F.col("op") == "incr", 1).otherwise(-1)
    sums = steps.groupBy("key").agg(F.sum(step).alias("moved"))
    out = base.select("key", start.alias("start"), F.col("base.op").alias("op")).join(sums, "key", "full")
    return out.where("moved IS NOT NULL OR op = 'set'").select("key", (F.coalesce("start", F.lit(0)) + F.coalesce("moved", F.lit(0))).alias("value"))


def hashes(log: DataFrame) -> DataFrame:
    """key, field, value: the last hset of each field that no hdel follows. Fields are rows, so a hash can be of any size."""
    last = since_del(log).where(F.col("op").isin("hset", "hdel")).groupBy("key", "field").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'hset'").select("key", "field", F.col("last.value").alias("value"))


def lists(log: DataFrame) -> DataFrame:
    """key, pos (from 0), value of pushes: a left push stands before all, a right one after all."""
    place = F.when(F.col("op") == "lpush", -F.col("seq")).otherwise(F.col("seq"))
    rows = since_del(log).where(F.col("op").isin("lpush", "rpush")).withColumn("place", place)
    return rows.select("key", "value", (F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1).cast("long").alias("pos"))


def popped(log: DataFrame) -> DataFrame:
    """key, value, pos of what stays when pops come after all pushes: each takes from its end."""
    held = lists(log).withColumn("size", F.count("*").over(Window.partitionBy("key")))
    pops = since_del(log).where(F.col("op").isin("lpop", "rpop")).groupBy("key").agg(F.count_if(F.col("op") == "lpop").alias("l"), F.count_if(F.col("op") == "rpop").alias("r"))
    kept = held.join(pops, "key", "left").where("pos >= coalesce(l, 0) AND pos < size - coalesce(r, 0)")
    return kept.select("key", "value", (F.col("pos") - F.coalesce("l", F.lit(0))).alias("pos"))


def replayed_lists(log: DataFrame) -> DataFrame:
    """key, pos, value of lists whose pushes, pops and dels run in order; a pop of an empty list does nothing.

    A recurrence, so a key's operations run in one task, and a list must fit into it.
    """

    def run(rows):
        held: deque = deque()
        for op, value in rows.sort_values("seq")[["op", "value"]].itertuples(index=False):
            if op == "lpush":
                held.appendleft(value)
            elif op == "rpush":
                held.append(value)
            elif op == "del":
                held.clear()
            elif held:
                held.popleft() if op == "lpop" else held.pop()
        return pd.DataFrame({"key": [rows["key"].iloc[0]] * len(held), "pos": range(len(held)), "value": pd.Series(list(held), dtype=object)})

    kinds = dict(log.dtypes)
    ops = log.where(F.col("op").isin("lpush", "rpush", "lpop", "rpop", "del")).select("key", "seq", "op", "value")
    return ops.groupBy("key").applyInPandas(run, f"key {kinds['key']}, pos long, value {kinds['value']}")


def list_range(log: DataFrame, start: int, stop: int) -> DataFrame:
    """lrange: negative ends count from the back, both ends belong to the range and are held to the list."""
    held = lists(log).withColumn("size", F.count("*").over(Window.partitionBy("key")))
    end = lambda n: F.lit(n) + F.col("size") if n < 0 else F.lit(n)
    return held.where((F.col("pos") >= F.greatest(end(start), F.lit(0))) & (F.col("pos") <= end(stop))).drop("size")


def members(log: DataFrame) -> DataFrame:
    """key, value of sets: the last sadd or srem of each member decides."""
    last = since_del(log).where(F.col("op").isin("sadd", "srem")).groupBy("key", "value").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'sadd'").select("key", "value")


def sorted_set(log: DataFrame) -> DataFrame:
    """key, value, score, rank (from 0) by score, then member; a new zadd moves a member."""
    last = since_del(log).where(F.col("op").isin("zadd", "zrem")).groupBy("key", "value").agg(F.max_by(F.struct("op", "score"), "seq").alias("last"))
    live = last.where("last.op = 'zadd'").select("key", "value", F.col("last.score").alias("score"))
    return live.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy("score", "value")) - 1).cast("long"))


def glob(column: Column, pattern: str) -> Column:
    """* is any run and ? any one character; everything else stands for itself."""
    return column.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def ttl_state(log: DataFrame, now: Column) -> DataFrame:
    """key, ttl: whole seconds left, -1 without expiry; keys whose time has come, or that nothing made, are gone (ttl -2 to one who asks).

    A set with a ttl of 0, or persist, clears the expiry; an expire or a set with a ttl starts it. An expire of a key
    that does not exist just then does nothing, and a del takes the expiry along.
    """
    made = F.when(F.col("op").isin(*MAKES), F.lit(True)).when(F.col("op") == "del", F.lit(False))
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_alive", F.last(made, ignorenulls=True).over(upto))
    ends = F.when((F.col("op") == "expire") | ((F.col("op") == "set") & (F.col("ttl") > 0)), F.col("ts") + F.col("ttl") * 1000)
    counts = F.col("op").isin("set", "persist", "del") | ((F.col("op") == "expire") & F.col("_alive"))
    state = rows.groupBy("key").agg(F.max_by("_alive", "seq").alias("alive"), F.max_by(F.struct(ends.alias("at")), F.when(counts, F.col("seq"))).alias("x"))
    left = state.where("alive").select("key", F.col("x.at").alias("ends")).where(F.col("ends").isNull() | (now < F.col("ends")))
    return left.select("key", F.when(F.col("ends").isNull(), F.lit(-1)).otherwise(F.floor((F.col("ends") - now) / 1000)).cast("long").alias("ttl"))


def entries(rows: DataFrame) -> DataFrame:
    """key, seq, held, put, n, field, value of operations of HOLDS: the container, whether something is put into it, and the bytes of what.

    field and value are null where they do not tell entries of the container apart.
    """
    held = F.coalesce(*(F.when(F.col("op").isin(*ops), name) for name, ops in HOLDS.items()))
    size = lambda column: F.octet_length(F.col(column).cast("string"))
    n = size("value") + F.when(F.col("held") == "hash", size("field")).when(F.col("held") == "zset", 8).otherwise(0)
    field, value = F.when(F.col("held") == "hash", F.col("field")), F.when(F.col("held").isin("set", "zset"), F.col("value"))
    return rows.withColumn("held", held).select("key", "seq", "held", F.col("op").isin(*MAKES).alias("put"), n.alias("n"), field.alias("field"), value.alias("value"))


def footprint(log: DataFrame) -> DataFrame:
    """key, mem_bytes over all containers: the key once a container, and its fields, values and members; a score takes 8.

    All containers go through one join and one aggregation, so a task holds the sorts and tables of one and not of five at
    once. The join carries the log's own columns, what follows from them is added after it. A list's entries are all
    there; of others the last operation decides.
    """
    rows = log.where(F.col("op").isin(*(op for ops in HOLDS.values() for op in ops)))
    rows = rows.select("key", "seq", "op", F.when(F.col("op").isin(*HOLDS["hash"]), F.col("field")).alias("field"), "value")
    gone = log.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("_gone"))
    rows = entries(rows.join(gone, "key", "left").where(F.col("op").isin(*HOLDS["kv"]) | F.expr("_gone IS NULL OR seq > _gone")))
    last = rows.groupBy("key", "held", "field", "value").agg(F.max_by("put", "seq").alias("put"), F.max_by("n", "seq").alias("n"), F.sum(F.when(F.col("held") == "list", F.col("n"))).alias("all"))
    live = last.where("put OR held = 'list'").withColumn("n", F.when(F.col("held") == "list", F.col("all")).otherwise(F.col("n")))
    sums = live.groupBy("key").agg(*(F.sum(F.when(F.col("held") == x, F.col("n"))).alias(f"_{x}") for x in HOLDS))
    key = F.octet_length(F.col("key").cast("string"))
    parts = [F.col(f"_{x}") + key for x in HOLDS]
    some = F.coalesce(*parts).isNotNull()
    return sums.select("key", F.when(some, sum((F.coalesce(x, F.lit(0)) for x in parts), F.lit(0))).cast("long").alias("mem_bytes"))


def exists(log: DataFrame) -> DataFrame:
    """key of every key that some container holds."""
    return footprint(log).select("key")


def lru(log: DataFrame, capacity: int, shards: int = 32, most_bytes: int | None = None, shard: Column | None = None) -> DataFrame:
    """Keys that stay when each shard holds its last touched ones: `capacity` of them, and of `most_bytes` in all (log column mem_bytes)."""
    shard = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(shards)) if shard is None else shard
    size = [F.max_by("mem_bytes", "seq").alias("mem_bytes")] if most_bytes is not None else []
    last = log.groupBy("key").agg(F.max("seq").alias("touched"), *size).withColumn("shard", shard)
    w = Window.partitionBy("shard").orderBy(F.desc("touched"))
    kept = last.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")
    return kept if most_bytes is None else kept.withColumn("_b", F.sum("mem_bytes").over(w)).where(F.col("_b") <= most_bytes).drop("_b")


def stats(log: DataFrame) -> DataFrame:
    """keys, bytes of string values, and the hit rate of gets on them."""
    held = last_set(log)
    size = held.agg(F.count("*").alias("keys"), F.sum(F.octet_length(F.col("key").cast("string")) + F.octet_length("value")).alias("mem_bytes"))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("set", "del"), F.col("op")), ignorenulls=True).over(before)
    asked = log.withColumn("_last", last).where("op = 'get'").agg(F.count_if(F.col("_last") == "set").alias("hits"), F.count_if(~F.coalesce(F.col("_last") == "set", F.lit(False))).alias("misses"))
    return size.join(asked, F.lit(True)).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))
