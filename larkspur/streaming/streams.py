"""Structured Streaming forms of the folds: last writer wins, counters of a key, channels, log tails."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where none is set and there is one machine only, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tail(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(path)


def latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Row of each key with the greatest order so far, as a streaming aggregate: state is one row a key."""
    columns = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("b")).select(key, *(F.col(f"b.{c}").alias(c) for c in columns))


def channel(stream: DataFrame, *names: str) -> DataFrame:
    return stream.where(F.col("channel").isin(*names))


def unexpired(stream: DataFrame, now_ms: int) -> DataFrame:
    return stream.where((F.coalesce("ttl", F.lit(0)) <= 0) | (F.lit(now_ms) <= F.col("created_at") + F.col("ttl") * 1000))


def windowed(stream: DataFrame, ts: str, width: str, late: str, *aggregates) -> DataFrame:
    """Aggregates of event-time windows; rows later than `late` behind the newest are left out and their state freed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(*aggregates)


def upsert_into(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Apply each batch to a table of newest rows, dealt into buckets by key; only the buckets that a batch touches are written.

    A bucket's versions are folders `_version=<batch>`; the greatest counts, and a batch that runs again writes the same.
    """

    def apply(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets`
        old = upserted(spark, path, rows.schema, before=k).where(F.col("_bucket").isin(touched)) if k else None
        newest = latest(rows if old is None else rows.unionByName(old.select(*rows.columns)), key, order)
        newest.withColumn("_version", F.lit(k)).repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema=None, before: int | None = None) -> DataFrame:
    """The table that upsert_into keeps: of each bucket its last version."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("_version") < before)
    last = F.broadcast(rows.groupBy("_bucket").agg(F.max("_version").alias("_version")))  # a row a bucket
    return rows.join(last, ["_bucket", "_version"], "left_semi").drop("_version")


def run_once(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All that is there, once, into Parquet files at path: a version a batch in complete mode, of which the last counts."""
    out, spark = f"{path}/rows", stream.sparkSession

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_version={k}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out) if query.lastProgress else spark.createDataFrame([], stream.schema).withColumn("_version", F.lit(0))
    if mode == "complete":
        rows = rows.where(F.col("_version") == rows.agg(F.max("_version")).first()[0])
    return rows.drop("_version")
