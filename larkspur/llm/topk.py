"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors lie in vertical layout, one row of the matrix a dimension. Inner products accumulate a block of dimensions
at a time; after a block, the mass that is left in the other dimensions bounds what a pair can still gain, and the
pairs that can no longer reach the query's running k-th best are compacted away. Queries and candidates are dealt into
blocks, and every block of queries meets every block of candidates in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import load, prepare

K, EVERY, BLOCK, QUERY_BLOCK, VECTOR_BLOCK, SCALE = 5, 50, 16, 4096, 65536, 256.0
#: Candidates that are offered to all queries of a block at once.
CHUNK = 512


def quantised(vec_ids, vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, integer vectors as doubles); null vectors and vectors with null or non-finite parts are left out."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(vec_ids, vectors, strict=True):
        if i is None or v is None or None in v:
            continue
        q = np.floor(SCALE * np.array(v, dtype=np.float64))
        if np.isfinite(q).all():
            ids, rows = by.setdefault(len(q), ([], []))
            ids.append(i)
            rows.append(q)
    return {d: (np.array(ids, np.int64), np.array(rows).reshape(len(ids), d)) for d, (ids, rows) in by.items()}


def exact_product(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Inner products beyond 2^53, in Python integers, held to the range of a long."""
    return [max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)]


class Search:
    """Running best k of a block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.k, d = ids, k, rows.shape[1]
        self.order = np.argsort(-np.abs(rows).sum(0), kind="stable") if len(rows) else np.arange(d)
        self.rows = np.ascontiguousarray(rows[:, self.order])
        self.cuts = list(range(0, d, BLOCK)) or [0]
        self.rest = self.mass(self.rows)
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def mass(self, rows: np.ndarray) -> np.ndarray:
        """Norm of what lies after each block of dimensions."""
        sq = np.square(rows)
        return np.sqrt(np.stack([sq[:, c + BLOCK :].sum(1) for c in self.cuts], axis=1)) if rows.shape[1] else np.zeros((len(rows), 1))

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        rows = rows[:, self.order]
        rest, columns = self.mass(rows), np.ascontiguousarray(rows.T)
        step = max(1, (1 << 20) // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            own = slice(at, at + step)
            floor = self.score[own, -1]
            part = self.rows[own, :BLOCK] @ columns[:BLOCK]
            bound = part + self.rest[own, :1] * rest[:, 0][None, :] * (1 + 1e-9) + 1e-6
            q, c = np.nonzero((bound >= floor[:, None]) & (self.ids[own, None] != ids[None, :]))
            part = part[q, c]
            for b, lo in enumerate(self.cuts[1:], 1):
                for dim in range(lo, min(lo + BLOCK, rows.shape[1])):
                    part = part + self.rows[own, dim][q] * columns[dim][c]
                alive = part + self.rest[own, b][q] * rest[c, b] * (1 + 1e-9) + 1e-6 >= floor[q]
                q, c, part = q[alive], c[alive], part[alive]
            self.merge(at, q, ids[c], part)

    def merge(self, at: int, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        all_q = np.concatenate([q, np.repeat(touched, self.k)])
        all_vec = np.concatenate([vec, self.vec[at + touched].ravel()])
        all_score = np.concatenate([score, self.score[at + touched].ravel()])
        order = np.lexsort((all_vec, -all_score, all_q))
        all_q, all_vec, all_score = all_q[order], all_vec[order], all_score[order]
        starts = np.searchsorted(all_q, touched)
        rank = np.arange(len(all_q)) - np.repeat(starts, np.diff([*starts, len(all_q)]))
        keep = rank < self.k
        self.score[at + all_q[keep], rank[keep]] = all_score[keep]
        self.vec[at + all_q[keep], rank[keep]] = all_vec[keep]


def meet(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query_id, vec_id, score of the k best of these candidates for each of these queries, all of one dimension."""
    most = max(np.abs(held[1]).max(initial=0), np.abs(rows).max(initial=0))
    if most**2 * max(rows.shape[1], 1) >= 2**52:
        return list(wide(held, ids, rows, k))
    s = Search(*held, k)
    for at in range(0, len(ids), CHUNK):  # bounds rise from chunk to chunk
        s.offer(ids[at : at + CHUNK], rows[at : at + CHUNK])
    q, r = np.nonzero(np.isfinite(s.score))
    return [(s.ids[q], s.vec[q, r], s.score[q, r].astype(np.int64))]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows of vectors, itself left out, ties to the smaller id.

    Both tables need vec_id and embedding. They are counted and dealt into blocks of about `block` and `vector_block`
    rows, whatever their ids; each side is shuffled, once for every block of the other, and nothing is broadcast or
    collected. Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
    vectors meet only vectors of their own dimension. As in the SQL of op6, rows that repeat an id are a candidate
    each, and each row of a query id asks, so the id's k best are over all of them and may hold equal entries. Empty
    tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def dealt(df: DataFrame, rows: int, least: int, own: str) -> tuple[DataFrame, int]:
        df = df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = max(least, -(-df.count() // rows))
        return df.withColumn(own, F.pmod(F.xxhash64(F.col("vec_id"), F.col("embedding")), F.lit(n)).cast("int")), n

    asked, blocks = dealt(queries, block, 1, "block")
    known, parts = dealt(vectors, vector_block, spark.sparkContext.defaultParallelism, "part")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        there = quantised(left["vec_id"].to_pylist(), left["embedding"].to_pylist())
        found = []
        for d, (ids, rows) in quantised(right["vec_id"].to_pylist(), right["embedding"].to_pylist()).items():
            if d in there:
                found += meet(there[d], ids, rows, k)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.asarray(x[c], np.int64) for x in found]) if found else [], pa.int64()) for c in range(3)], schema=schema)

    found = asked.groupBy("block", "part").cogroup(known.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def wide(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray, k: int):
    """Best k of this batch where doubles could round."""
    for qid, q in zip(*held, strict=True):
        scores = exact_product(np.broadcast_to(q, rows.shape), rows)
        best = sorted((-s, int(i)) for s, i in zip(scores, ids, strict=True) if i != qid)[:k]
        if best:
            yield np.full(len(best), qid), np.array([i for _, i in best]), np.array([-s for s, _ in best])


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op6_exact_topk": op6_exact_topk}
SQL = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
