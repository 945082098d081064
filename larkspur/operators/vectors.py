"""Exact vector search: every metric as a column expression, best k by a bounded heap a partition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")
DEFAULT_K, DEFAULT_MIN, TINY = 10, -1e9, 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity: higher is nearer. Vectors of unlike length have none."""
    if metric == "cosine":
        value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + TINY)
    elif metric == "dot":
        value = dot(a, b)
    elif metric == "euclidean":
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        value = 1.0 / (1.0 + F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)))
    else:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    return F.when(F.size(a) == F.size(b), value)


def search(df: DataFrame, query: list[float], k: int = DEFAULT_K, metric: str = "cosine", min_score: float = DEFAULT_MIN, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows most like query, best first, ties by key; other columns ride along."""
    scored = df.withColumn("score", score(F.col(vector), F.array(*(F.lit(float(x)) for x in query)), metric))
    return scored.filter(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)


def search_many(df: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", most: int = 2_000) -> DataFrame:
    """query_id, key, score of each query's best k, ties by key. queries (query_id, query) are counted and dealt into blocks of about `most` rows.

    Blocks of queries meet blocks of vectors in tasks of their own: both sides are shuffled, none is broadcast, and a
    task multiplies its two matrices and hands on k rows a query. A null or empty vector, and one of another length, meets nothing.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    blocks = max(1, -(-queries.count() // most))
    parts = df.sparkSession.sparkContext.defaultParallelism
    cast = lambda c: F.col(c).cast("array<double>").alias("v")
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    kind = dict(df.dtypes)[key]
    asked_kind = dict(queries.dtypes)["query_id"]
    vectors = df.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), spread, F.col(key).alias("id"), cast(vector))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("query_id"), cast("query"))

    def meet(left: Iterator[pd.DataFrame], right: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [(i, np.array(v, float)) for part in right for i, v in zip(part["query_id"], part["v"], strict=True) if v is not None and len(v)]
        by = {n: ([i for i, v in known if len(v) == n], np.stack([v for _, v in known if len(v) == n])) for n in {len(v) for _, v in known}}
        best: dict = {}
        for part in left:
            for n, (ids, q) in by.items():
                own = [(i, v) for i, v in zip(part["id"], part["v"], strict=True) if v is not None and len(v) == n]
                if not own:
                    continue
                names, rows = [i for i, _ in own], np.stack([np.array(v, float) for _, v in own])
                found = matrix_score(q, rows, metric)
                for j, i in enumerate(ids):
                    near = np.flatnonzero(found[j] >= np.partition(found[j], -k)[-k]) if len(names) > k else np.arange(len(names))
                    held = best.setdefault((n, j), (i, []))[1]
                    held.extend((-found[j][x], names[x]) for x in near if not np.isnan(found[j][x]))
                    held.sort()
                    del held[k:]
        rows = [(i, name, -s) for i, held in best.values() for s, name in held]
        yield pd.DataFrame(rows, columns=["query_id", key, "score"])

    found = vectors.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(lambda a, b: pd.concat(meet(iter([a]), iter([b]))), f"query_id {asked_kind}, `{key}` {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def matrix_score(q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """score() of every query with every row."""
    if metric == "euclidean":
        return 1.0 / (1.0 + np.sqrt(np.stack([np.square(rows - x).sum(1) for x in q])))
    product = q @ rows.T
    return product if metric == "dot" else product / (np.sqrt(np.square(q).sum(1))[:, None] * np.sqrt(np.square(rows).sum(1))[None, :] + TINY)


def remove(df: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    """df without the vectors of these keys."""
    return df.join(keys.select(key), key, "left_anti")


@dataclass
class Registry:
    """One vector index a collection, its dimension fixed by the first vectors that go in; kept as Parquet."""

    indexes: dict[tuple[str, str, str], tuple[DataFrame, int]] = field(default_factory=dict)

    def insert(self, name: tuple[str, str, str], new: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        held, dimension = self.indexes.get(name, (None, None))
        if dimension is None:
            first = new.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
            dimension = first[0] if first else 0
        if not violations(new, dimension, vector).isEmpty():
            raise ValueError(f"vectors of {name} have {dimension} components")
        self.indexes[name] = (new if held is None else upsert(held, new, key, vector), dimension)
        return self.indexes[name][0]

    def save(self, name: tuple[str, str, str], path: str) -> None:
        self.indexes[name][0].write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, name: tuple[str, str, str], path: str, vector: str = "embedding") -> DataFrame:
        df = spark.read.parquet(path)
        first = df.select(F.size(vector)).first()
        self.indexes[name] = (df, first[0] if first else 0)
        return df


def upsert(df: DataFrame, new: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """new replaces rows of the same key; the index's dimension is checked by violations()."""
    return df.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def violations(df: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    return df.where((F.size(vector) != dimension) | F.col(vector).isNull())
