"""Consistent hashing of keys to shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VNODES, LEAST_VNODES = 256, 128
#: Basis and prime of the FNV-1a hash, then shifts and factors of the splitmix finaliser.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SHIFTS, FACTORS = (30, 27, 31), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def positions(keys: pa.Array) -> np.ndarray:
    """Place of each key on the ring: bytes of all keys are hashed together, the j-th of each at once. Null is an empty key."""
    raw = keys.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    start, size = ends[:-1], np.diff(ends)
    h = np.full(len(raw), FNV_BASIS, np.uint64)
    for j in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > j)
        h[own] = (h[own] ^ data[start[own] + j]) * np.uint64(FNV_PRIME)
    for shift, factor in zip(SHIFTS, FACTORS, strict=False):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(SHIFTS[-1]))


class Ring:
    """Shards without a name are left out; a shard has LEAST_VNODES places at least."""

    def __init__(self, shards: list[str], vnodes: int = VNODES):
        names = [s for s in shards if s for _ in range(max(vnodes, LEAST_VNODES))]
        if not names:
            raise ValueError("a ring needs a shard")
        spots = positions(pa.array([f"{s}#{v}" for s, v in zip(names, [*range(max(vnodes, LEAST_VNODES))] * len(names), strict=False)]))
        order = np.argsort(spots, kind="stable")
        self.points, self.owners = spots[order], np.array(names, object)[order]

    def owner(self, key: str) -> str:
        return self.owned(pa.array([key]))[0]

    def owned(self, keys: pa.Array) -> np.ndarray:
        return self.owners[np.searchsorted(self.points, positions(keys)) % len(self.points)]

    def route(self, key: Column) -> Column:
        """Owner of each key: the first point of the ring at or after the key's."""

        @F.arrow_udf("string")
        def run(keys: pa.Array) -> pa.Array:
            return pa.array(self.owned(keys), pa.string())

        return run(key.cast("string"))


def moves(df: DataFrame, key: str, old: Ring, new: Ring) -> DataFrame:
    """Rows whose owner changes, with both owners."""
    return df.withColumn("old_owner", old.route(F.col(key))).withColumn("new_owner", new.route(F.col(key))).where("old_owner <> new_owner")


def dealt(df: DataFrame, key: str, ring: Ring) -> DataFrame:
    """df with its owner, one owner's rows together: what a bulk insert sends to each shard."""
    return df.withColumn("owner", ring.route(F.col(key))).repartition("owner")
