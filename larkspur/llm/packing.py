"""Best-fit packing of tokenised documents by exact-complement hashing.

Planning works on the histogram of piece lengths, which has at most `capacity` entries whatever the corpus, so the
driver's share is bounded. Pieces never gather by length: each task ranks its own pieces of a length, and ranks are
turned into places by prefix sums over (task, length) counts.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, load, prepare

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level BPE of byte_bpe_50k.json through its rank table, which gives the same ids about three times as fast.

    tests/llm/test_llm_operators.py holds the ids against the `tokenizers` library.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """Ids of a whole text; a null text is an empty one. The special token's string is its id, as `tokenizers` has it."""
    if not text:
        return []
    e = encoder(vocabulary)
    return e.encode(text, allowed_special={SPECIAL}, disallowed_special=()) if SPECIAL in text else e.encode_ordinary(text)


class Sums:
    """Index of the lengths in stock by the sums of one, two and three of them.

    Pairs are filed under their sums once. Stock only runs out, so what is found spent at the front of a sum's file is
    passed over for good, and the index stays current. A triple is a longest part with a pair filed under what is left.
    """

    def __init__(self, stock: Counter[int], capacity: int):
        self.stock = stock
        lengths = np.array(sorted((n for n in stock if n < capacity), reverse=True), dtype=np.int64)
        a, b = np.triu_indices(len(lengths))
        a, b = lengths[a], lengths[b]
        fits = a + b <= capacity
        a, b = a[fits], b[fits]
        order = np.argsort(a + b, kind="stable")  # of equal sums, the pair with the longest part first
        self.a, self.b = a[order], b[order]
        starts = np.searchsorted((self.a + self.b), np.arange(capacity + 2))
        self.next, self.stop = starts[:-1].copy(), starts[1:]
        self.lengths, self.longest = lengths.tolist(), {}

    def have(self, *parts: int) -> bool:
        return all(self.stock.get(n, 0) >= k for n, k in Counter(parts).items())

    def pairs(self, total: int):
        """Pairs in stock that add up to total."""
        while self.next[total] < self.stop[total] and not self.have(int(self.a[self.next[total]]), int(self.b[self.next[total]])):
            self.next[total] += 1
        for at in range(self.next[total], self.stop[total]):
            pair = int(self.a[at]), int(self.b[at])
            if self.have(*pair):
                yield pair

    def triples(self, total: int):
        """Triples in stock that add up to total, each once, its longest part first."""
        at = self.longest.get(total, 0)
        front = True
        while at < len(self.lengths) and 3 * self.lengths[at] >= total:
            a, live = self.lengths[at], False
            if a < total and self.stock.get(a):
                for b, c in self.pairs(total - a):
                    live = True
                    if b <= a and self.have(a, b, c):
                        yield a, b, c
            at += 1
            front = front and not live
            if front:
                self.longest[total] = at

    def filling(self, head: int, gap: int) -> tuple[int, ...] | None:
        """head and what fills the gap beside it exactly: nothing, one length, two or three."""
        if gap == 0:
            return (head,)
        if self.have(head, gap):
            return (head, gap)
        for parts in chain(self.pairs(gap), self.triples(gap)):
            if self.have(head, *parts):
                return (head, *parts)
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that use up every piece of the histogram.

    Longest pieces first. The gap beside a piece is looked up among single lengths, then pair sums, then triple
    sums; a combination that fills it exactly is used as often as the counts allow. What no combination fills
    exactly is placed by best fit: the longest piece that fits into the gap, again and again.
    """
    left = Counter({n: c for n, c in lengths.items() if c > 0})
    out: list[tuple[tuple[int, ...], int]] = []

    def spend(parts: tuple[int, ...]) -> None:
        need = Counter(parts)
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        out.append((parts, times))

    sums = Sums(left, capacity)
    for head in sorted(left, reverse=True):
        while left.get(head) and (parts := sums.filling(head, capacity - head)):
            spend(parts)
    while left:
        parts, gap = [head := max(left)], capacity - head
        used = Counter(parts)
        for n in sorted(left, reverse=True):
            while n <= gap and used[n] < left[n]:
                parts.append(n)
                used[n] += 1
                gap -= n
        spend(tuple(parts))
    return out


def slots(plans: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of places in rank order: the rank-th piece of a length goes to the run that holds its rank."""
    rows, base = [], 0
    seen: Counter[int] = Counter()
    for parts, times in plans:
        at = 0
        for n in parts:
            rows.append((n, seen[n], base, at))
            seen[n] += times
            at += n
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank (among the task's pieces of that length) and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text), END_ID], dtype="<u4")
                n = len(ids)
                first = n - (n - 1) // capacity * capacity
                start, k = 0, 0
                while start < n:
                    length = first if k == 0 else capacity
                    own = ids[start : start + length]
                    row = (doc, k, start, length, zlib.crc32(own.tobytes()), task, seen[length])
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    seen[length] += 1
                    start += length
                    k += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=False)], names[: len(columns)])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Place every document's pieces into as few sequences of at most `capacity` tokens as exact complements and best fit find.

    docs needs doc_id and text; other columns are ignored. A null or empty text is one piece of one token. Repeated
    rows are packed each for itself, and a null doc_id stays null. An empty table gives no rows. Long texts are cut
    into pieces of `capacity` tokens, the first of which takes the remainder.
    """
    spark = docs.sparkSession
    cuts = cut(pieces(docs, capacity, with_ids))
    counts = cut(cuts.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # at most a few runs for each length
    order = Window.partitionBy("length").orderBy("task")
    before = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")

    def place(batches):
        t = table.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            first, last = np.searchsorted(t["length"], length, "left"), np.searchsorted(t["length"], length, "right")
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = int(first[own][0]), int(last[own][0])
                at[own] = lo + np.searchsorted(t["rank"][lo:hi], rank[own], "right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(t["offset"][at], pa.int64())], [*kept, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = cuts.join(before, ["task", "length"]).select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
