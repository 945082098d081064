"""Databases, schemas and collections over DataFrames; backup, restore and change feeds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hlc import merge
from larkspur.operators.find import live

DEFAULT_DATABASE, DEFAULT_SCHEMA = "default", "public"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass
class Catalog:
    """Names to collections. A collection is a DataFrame and its settings; writes replace the frame."""

    tables: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)
    settings: dict[tuple[str, str, str], dict] = field(default_factory=dict)

    def create(self, name: str, df: DataFrame, schema: str = DEFAULT_SCHEMA, database: str = DEFAULT_DATABASE, **settings) -> DataFrame:
        self.tables[database, schema, name] = df
        self.settings[database, schema, name] = settings
        return df

    def get(self, name: str, schema: str = DEFAULT_SCHEMA, database: str = DEFAULT_DATABASE) -> DataFrame:
        return self.tables[database, schema, name]

    def drop(self, name: str, schema: str = DEFAULT_SCHEMA, database: str = DEFAULT_DATABASE) -> None:
        self.tables.pop((database, schema, name), None)
        self.settings.pop((database, schema, name), None)

    def drop_database(self, database: str) -> None:
        for key in [k for k in self.tables if k[0] == database]:
            self.drop(key[2], key[1], key[0])

    def collections(self, database: str | None = None, schema: str | None = None) -> list[tuple[str, str, str]]:
        return sorted(k for k in self.tables if (database is None or k[0] == database) and (schema is None or k[1] == schema))

    def databases(self) -> dict[str, int]:
        """Collections a database."""
        out: dict[str, int] = {}
        for d, _, _ in self.tables:
            out[d] = out.get(d, 0) + 1
        return out


    def schemas(self, database: str = DEFAULT_DATABASE) -> dict[str, int]:
        """Collections a schema."""
        out: dict[str, int] = {}
        for d, s, _ in self.tables:
            if d == database:
                out[s] = out.get(s, 0) + 1
        return out

    def listing(self, spark: SparkSession, database: str | None = None) -> DataFrame:
        """database, schema, name, document_count of each collection; the counts are one job."""
        kind = "database string, schema string, name string, document_count long"
        counts = [self.tables[k].agg(F.count("*").alias("document_count")).select(*(F.lit(x).alias(n) for x, n in zip(k, ("database", "schema", "name"), strict=True)), "document_count") for k in self.collections(database)]
        return reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], kind)


def get(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key. The filter goes down to the scan, which skips row groups by their bounds and bloom filters."""
    return df.where(F.col(key) == F.lit(value))


def get_document(df: DataFrame, value: object, now_ms: int, key: str = "_id") -> DataFrame:
    """The row of one key, if it is no tombstone and has not expired."""
    return get(live(df, now_ms), key, value)


def snapshot(df: DataFrame, lsn: int, now_ms: int | None = None) -> DataFrame:
    """All live rows with the log position that they were taken at: where a reader begins that has missed changes."""
    return live(df, now_ms).withColumn("lsn", F.lit(lsn).cast("long"))


def write_indexed(df: DataFrame, path: str, prefix: list[str], bloom: list[str] | None = None, files: int | None = None) -> None:
    """Rows in ranges of a composite key, sorted by it, with bloom filters on some columns.

    Equality on a leading part of the key then reads few files and row groups, a point get fewer yet.
    """
    rows = df.repartitionByRange(*([files] if files else []), *prefix).sortWithinPartitions(*prefix)
    writer = rows.write.mode("overwrite")
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def uses_index(df: DataFrame, *columns: str) -> bool:
    """Whether the scan of df gets a filter on all of these columns pushed down."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))
    return bool(pushed) and all(re.search(rf"\({re.escape(c)}[,)]", pushed) for c in columns)


def key_range(df: DataFrame, key: str, start: str, end: str, limit: int | None = None, seq: str | None = None) -> DataFrame:
    """Rows with start <= key < end, by key. seq: the rows are versions, of which the newest of each key counts, unless it is a tombstone."""
    df = newest(df.where((F.col(key) >= start) & (F.col(key) < end)), key, seq) if seq else df
    out = df.where((F.col(key) >= start) & (F.col(key) < end)).orderBy(key)
    return out if limit is None else out.limit(limit)


def newest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Newest version of each key, tombstones gone: what compaction keeps."""
    columns = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("b")).select(key, *(F.col(f"b.{c}").alias(c) for c in columns))
    return best.where("NOT coalesce(tombstone, false)") if "tombstone" in columns else best


def changes(log: DataFrame, from_lsn: int, limit: int) -> DataFrame:
    return log.where(F.col("lsn") > from_lsn).orderBy("lsn").limit(limit)


def has_gap(log: DataFrame, from_lsn: int) -> bool:
    """Whether records after from_lsn are no longer held, so that a reader needs a snapshot."""
    first = log.agg(F.min("lsn")).first()[0]
    return first is not None and first > from_lsn + 1


def backup(df: DataFrame, path: str, key: str, lsn: int, now_ms: int, version: str = "1") -> None:
    """(key, value as JSON) records and what they were taken at, as JSON lines. The count is that of the records written."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    rows.write.mode("overwrite").json(f"{path}/records")
    count = df.sparkSession.read.schema("key string").json(f"{path}/records").count()
    df.sparkSession.createDataFrame([(lsn, count, now_ms, version)], "lsn long, count long, timestamp_ms long, version string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def restore(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Rows of a backup, and how many records lacked a key or value and were skipped."""
    rows = spark.read.schema("key string, value string").json(f"{path}/records")
    whole = F.col("key").isNotNull() & F.col("value").isNotNull()
    skipped = rows.agg(F.count_if(~whole)).first()[0]
    return rows.where(whole).select(F.from_json("value", schema).alias("v")).select("v.*"), skipped


def restore_into(df: DataFrame, path: str, schema: str, key: str = "_id") -> tuple[DataFrame, int]:
    """df with a backup's rows merged in, last writer first, and the number of records skipped."""
    rows, skipped = restore(df.sparkSession, path, schema)
    return merge(df, rows, key), skipped


def write_log(df: DataFrame, path: str, channel: str = "main") -> None:
    """Append rows to a channel's JSON lines: main, audit or slow."""
    df.withColumn("channel", F.lit(channel)).write.mode("append").partitionBy("channel").json(path)
