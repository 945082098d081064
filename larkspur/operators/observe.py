"""Observability aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed upper bounds of the latency buckets, in milliseconds.
BUCKETS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000]


def bucket(ms: Column, bounds: list[float] = BUCKETS) -> Column:
    out = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        out = F.when(ms <= b, F.lit(float(b))).otherwise(out)
    return out


def histogram(df: DataFrame, route: str, ms: str, bounds: list[float] = BUCKETS) -> DataFrame:
    """route, le, cumulative; buckets without rows are left out. Counted before the window, which sees one row a bucket."""
    counts = df.groupBy(F.col(route).alias("route"), bucket(F.col(ms), bounds).alias("le")).agg(F.count("*").alias("n"))
    return counts.select("route", "le", F.sum("n").over(Window.partitionBy("route").orderBy("le")).alias("cumulative"))


def quantiles(df: DataFrame, route: str, ms: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99), exact: bool = False) -> DataFrame:
    f = F.percentile if exact else F.percentile_approx
    return df.groupBy(F.col(route).alias("route")).agg(*(f(ms, q).alias(f"p{round(q * 100)}") for q in qs))


def ratio_by_window(df: DataFrame, ts: str, bad: Column, width: str = "1 day") -> DataFrame:
    """start, total, bad, ratio for each window of time."""
    rows = df.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(F.count("*").alias("total"), F.count_if(bad).alias("bad"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "total", "bad", F.try_divide("bad", "total").alias("ratio"))


def rate_limited(df: DataFrame, key: str, ts: str, attempts: int = 10, seconds: int = 300) -> DataFrame:
    """df with the attempts of the same key in the seconds up to each row, and whether they are too many."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > attempts)


def canonical_route(path: Column) -> Column:
    """Long hexadecimal segments stand for ids."""
    return F.regexp_replace(path, r"(?<=/)[0-9a-fA-F_-]{16,}(?=/|$)", ":id")


def token_bucket(df: DataFrame, key: str, ts_seconds: str, rate: float, burst: float) -> DataFrame:
    """df with allowed: a bucket of `burst` tokens a key refills at `rate` a second. A recurrence, so a task a key."""
    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(rows):
        rows = rows.sort_values(ts_seconds, kind="stable")
        left, last, out = burst, None, []
        for t in rows[ts_seconds]:
            left = min(burst, left + (0 if last is None else (t - last) * rate))
            last = t
            out.append(left >= 1)
            left -= left >= 1
        return rows.assign(allowed=out)

    return df.groupBy(key).applyInPandas(run, schema)


def status_classes(df: DataFrame, status: str = "status") -> DataFrame:
    """status_class (2 for 200 to 299, and so on) and its requests."""
    return df.groupBy(F.floor(F.col(status) / 100).cast("int").alias("status_class")).agg(F.count("*").alias("requests"))


def exposition(df: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """line: a metric's rows as text that a scraper reads, one line each."""
    quoted = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.col(x).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for x in labels]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}")) if labels else F.lit("")
    return df.select(F.concat(F.lit(name), inside, F.lit(" "), F.col(value).cast("string")).alias("line"))
