"""Set-based writes: inserts that skip duplicates, unique constraints, and transactions that apply wholly or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.updates import apply_update


def insert_new(df: DataFrame, new: DataFrame, key: str = "_id", order: str | None = None) -> DataFrame:
    """df and the rows of new whose key df lacks, the first of each key by order; expired rows still hold their key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*([order] if order else new.columns)))
    fresh = new.withColumn("_r", rank).where("_r = 1").drop("_r").join(df.select(key), key, "left_anti")
    return df.unionByName(fresh, allowMissingColumns=True)


def unique_violations(df: DataFrame, fields: list[str], sparse: bool = False) -> DataFrame:
    """Values that several rows have, with their count; missing fields are a value unless sparse."""
    rows = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in fields)) if sparse else df
    return rows.groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")


def judge(base: DataFrame, ops: DataFrame, key: str = "_id") -> DataFrame:
    """ops (seq, op insert/update/remove, key, expected_version) with a status: OK, DUPLICATE, NOT_FOUND or CONFLICT.

    Whether a key exists when an op runs follows from the op before it on that key, or from base. Only updates ask for
    a version, that of the row before the transaction; a row that the transaction itself inserts had none.
    """
    held = base.select(key, F.col("version").alias("_v"))
    before = F.lag("op").over(Window.partitionBy(key).orderBy("seq"))
    rows = ops.join(held, key, "left").withColumn("_prev", before)
    there = F.when(F.col("_prev").isNull(), F.col("_v").isNotNull()).otherwise(F.col("_prev") != "remove")
    status = (
        F.when((F.col("op") == "insert") & there, "DUPLICATE")
        .when((F.col("op") != "insert") & ~there, "NOT_FOUND")
        .when((F.col("op") == "update") & (F.coalesce("expected_version", F.lit(0)) != 0) & (F.col("expected_version") != F.coalesce("_v", F.lit(0))), "CONFLICT")
        .otherwise("OK")
    )
    return rows.withColumn("status", status).drop("_v", "_prev")


def execute(base: DataFrame, ops: DataFrame, now_ms: int, key: str = "_id", unique: list[str] | None = None) -> tuple[DataFrame, str]:
    """New state of base (key, value, version, updated_at) and a status. Anything but COMMITTED leaves base as it was.

    Each key takes the last op's value and one step of its version however many updates it had; a removed key goes.
    """
    judged = judge(base, ops, key)
    bad = judged.where("status <> 'OK'").orderBy("seq").select("status").limit(1).collect()
    if bad:
        return base, bad[0][0]
    last = judged.groupBy(key).agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    merged = base.join(last, key, "full")
    touched = F.col("x").isNotNull()
    after = merged.where("x IS NULL OR x.op <> 'remove'").select(
        key,
        F.when(touched, F.col("x.value")).otherwise(F.col("value")).alias("value"),
        F.when(touched, F.coalesce(F.col("version"), F.lit(0)) + 1).otherwise(F.col("version")).alias("version"),
        F.when(touched, F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    if unique and not unique_violations(after, unique).isEmpty():
        return base, "DUPLICATE"
    return after, "COMMITTED"


def insert_many(df: DataFrame, new: DataFrame, key: str = "_id", unique: list[str] | None = None, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df with the rows of new that may come in, and key, status of each: OK, DUPLICATE or TOO_LARGE.

    Of rows that share a key, or values of the unique fields, the first by all its columns comes in; rows that
    differ from one held only by being refused do not stop the others.
    """
    w = Window.partitionBy(key).orderBy(*(c for c, t in new.dtypes if not t.startswith("map")))
    rows = new.withColumn("_n", F.row_number().over(w)).join(df.select(key, F.lit(True).alias("_held")), key, "left")
    large = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in new.columns)))) > most_bytes if most_bytes else F.lit(False)
    status = F.when(large, "TOO_LARGE").when(F.col("_held") | (F.col("_n") > 1), "DUPLICATE").otherwise("OK")
    rows = rows.withColumn("status", status).drop("_n", "_held")
    if unique:
        first = F.row_number().over(Window.partitionBy(*unique, "status").orderBy(key))
        taken = df.select(*(F.col(c).alias(f"_{c}") for c in unique)).distinct().withColumn("_taken", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in unique]
        rows = rows.withColumn("_first", first).join(taken, same, "left")
        rows = rows.withColumn("status", F.when((F.col("status") == "OK") & (F.col("_taken") | (F.col("_first") > 1)), "DUPLICATE").otherwise(F.col("status"))).select(*new.columns, "status")
    return df.unionByName(rows.where("status = 'OK'").select(*new.columns), allowMissingColumns=True), rows.select(key, "status")


def inserted(report: DataFrame, key: str = "_id") -> DataFrame:
    """inserted, ids: what a bulk insert answers. ids is an array of all inserted keys, so a request's own size bounds it."""
    return report.where("status = 'OK'").agg(F.count("*").alias("inserted"), F.array_sort(F.collect_list(key)).alias("ids"))


def replay(base: DataFrame, ops: list[dict], key: str = "_id") -> DataFrame:
    """The rows of base that ops touch, after all of them in order: what a read inside the transaction sees.

    ops are the transaction's own: {"op": insert, update or remove, "id": ..., "doc": row} or "update": update document.
    """
    rows = base.where(F.col(key).isin([op["id"] for op in ops]))
    for op in ops:
        mine = F.col(key) == F.lit(op["id"])
        if op["op"] == "update":
            rows = apply_update(rows, op["update"], mine)
        else:
            rows = rows.where(~mine)
            if op["op"] == "insert":
                new = base.sparkSession.createDataFrame([(op["id"],)], f"{key} {dict(base.dtypes)[key]}")
                for name, value in op["doc"].items():
                    new = new.withColumn(name, F.lit(value).cast(dict(rows.dtypes).get(name, "string")) if name in rows.columns else F.lit(value))
                rows = rows.unionByName(new, allowMissingColumns=True)
    return rows


def run(base: DataFrame, ops: list[dict], now_ms: int, reads: dict | None = None, unique: list[str] | None = None, key: str = "_id", allowed=None) -> tuple[DataFrame, str]:
    """New state of base (key, version, updated_at, fields) and a status, as the ops of one transaction leave it.

    reads: versions that the transaction has read, by key (0 for a row it found missing); any other now is a CONFLICT.
    allowed(op, rows) may refuse an op for the rows it would change: FORBIDDEN. Updates apply in order, so later ones
    see what earlier ones left; a touched row goes one version up. Anything but COMMITTED leaves base as it was. The
    driver holds the ops and as many versions as they name.
    """
    names = {op["id"] for op in ops} | set(reads or {})
    held = {r[0]: r[1] for r in base.where(F.col(key).isin(list(names))).select(key, "version").collect()}
    if any(held.get(k, 0) != v for k, v in (reads or {}).items()):
        return base, "CONFLICT"
    there = set(held)
    for k, op in enumerate(ops):
        kind, i = op["op"], op["id"]
        if (kind == "insert") == (i in there):
            return base, "DUPLICATE" if kind == "insert" else "NOT_FOUND"
        if kind == "update" and op.get("expected_version") and held.get(i, 0) != op["expected_version"]:
            return base, "CONFLICT"
        if allowed and not allowed(op, replay(base, ops[: k + (kind == "insert")], key).where(F.col(key) == F.lit(i)) if k or kind == "insert" else base.where(F.col(key) == F.lit(i))):
            return base, "FORBIDDEN"
        there = there - {i} if kind == "remove" else there | {i}
    touched = [op["id"] for op in ops]
    rest = base.where(~F.col(key).isin(touched))
    before = F.create_map(*(F.lit(x) for i in set(touched) for x in (i, held.get(i, 0)))) if touched else None
    rows = replay(base, ops, key)
    if touched:
        rows = rows.withColumn("version", before[F.col(key)] + 1).withColumn("updated_at", F.lit(now_ms))
    after = rest.unionByName(rows, allowMissingColumns=True)
    if unique and touched:
        mine = rows.select(*unique)
        if not unique_violations(after.join(mine.distinct(), unique, "left_semi"), unique).isEmpty():
            return base, "DUPLICATE"
    return after, "COMMITTED"
