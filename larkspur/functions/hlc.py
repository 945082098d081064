"""Hybrid logical clocks: 48 bits of milliseconds and 16 of a counter, written as 16 hexadecimal digits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DRIFT_MS = 60_000


def render(ms: Column, counter: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(ms), 12, "0"), F.lpad(F.hex(counter), 4, "0")))


def millis(hlc: Column) -> Column:
    return F.conv(F.substring(hlc, 1, 12), 16, 10).cast("long")


def counter(hlc: Column) -> Column:
    return F.conv(F.substring(hlc, 13, 4), 16, 10).cast("int")


@dataclass
class Clock:
    """One node's clock. Time never goes back; a full counter moves on by a millisecond."""

    ms: int = 0
    count: int = 0

    def tick(self, now_ms: int) -> str:
        return self._move(max(now_ms, self.ms), (self.ms, self.count))

    def update(self, remote: str, now_ms: int) -> str:
        """After a message. A remote time over a minute ahead is taken as that minute, its counter as 0."""
        there, theirs = parse(remote)
        if there > now_ms + MAX_DRIFT_MS:
            there, theirs = now_ms + MAX_DRIFT_MS, 0
        return self._move(max(now_ms, self.ms, there), (self.ms, self.count), (there, theirs))

    def _move(self, ms: int, *readings: tuple[int, int]) -> str:
        """To ms, past every reading of that time."""
        count = max((n + 1 for t, n in readings if t == ms), default=0)
        if count > 0xFFFF:
            ms, count = ms + 1, 0
        self.ms, self.count = ms, count
        return f"{ms:012x}{count:04x}"


def parse(text: str) -> tuple[int, int]:
    """Milliseconds and counter of 16 hexadecimal digits; anything else is an error."""
    if not re.fullmatch("[0-9a-fA-F]{16}", text or ""):
        raise ValueError(f"not a clock reading: {text!r}")
    return int(text[:12], 16), int(text[12:], 16)


def merge(local: DataFrame, remote: DataFrame, key: str = "_id") -> DataFrame:
    """Last writer wins: the row of each key with the greater _hlc, tombstones too; ties stay local."""
    rows = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_local")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce("_hlc", F.lit("")), "_local")).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in columns))


def changes_since(df: DataFrame, since: str = "", limit: int = 1024) -> DataFrame:
    """Rows written after a clock reading, oldest first, tombstones included."""
    return df.where(F.col("_hlc") > since).orderBy("_hlc", "_id").limit(limit)


def latest_change(df: DataFrame, since: str = "", limit: int = 1024) -> DataFrame:
    """max_hlc: where the next changes_since begins; since itself if nothing came."""
    return changes_since(df, since, limit).agg(F.coalesce(F.max("_hlc"), F.lit(since)).alias("max_hlc"))
