"""Session helpers and vectorised word hashing shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that cross into Python at once; whole texts can be long, so batches are short.
TEXT_BATCH = "512"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches. Checkpoints need a folder that all executors share, named by the session or its context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH)
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="larkspur-")  # one machine only, as in tests
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for the block alone."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class shared_folder:
    """A folder of this name where checkpoints go, which all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/{name}"

    def delete(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a checkpoint of narrow rows that one partition holds, and that are broadcast at most.
NARROW_BYTES = 8 << 20


def cut(df: DataFrame, short: bool = True, narrow: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files, so that no lost executor loses it.

    A checkpointed frame carries its plan's size estimate along, and each join multiplies the estimates of its sides:
    in a loop that number gets so long that it fills the driver. So the files are wrapped anew, without an estimate.
    Shuffle files that led to the checkpoint are of no more use once it is written; they go then and not at the
    driver's next garbage collection. The setting is read when a frame is made and holds for this one alone.
    short: with Arrow batches of the usual length for texts.
    narrow: rows of a few numbers, which cost little each. They go on in as few partitions as the bytes written ask for; a
    single one is grouped without a shuffle and broadcast to joins. Rounds over a small graph would otherwise be all tasks and no rows.
    """
    spark = df.sparkSession
    if short:
        prepare(spark)
    with settings(spark, {CLEANUP: "true"}):
        last = df.select("*")
    saved = last.checkpoint(eager=True)._jdf
    rows = DataFrame(spark._jsparkSession.internalCreateDataFrame(saved.queryExecution().toRdd(), saved.schema(), False), spark)
    if not narrow:
        return rows
    written = saved.queryExecution().analyzed().rdd()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.getCheckpointFile().get())
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    few = -(-size // NARROW_BYTES)
    if few <= 1:
        return F.broadcast(rows.coalesce(1))
    return rows.coalesce(few) if few < written.getNumPartitions() else rows


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name that df does not use, built from the first wanted one."""
    name = wanted[0]
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null gives b''."""
    return [x if x is not None else b"" for x in column.cast("binary").to_pylist()]


class WordCodes(dict):
    """word bytes -> well-mixed 64-bit code. Emptied when large: codes depend on the word alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def word_codes(words: list[bytes], cache: WordCodes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of every k consecutive codes; the same run of words gives the same value anywhere."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, b = np.zeros(n, np.uint64), np.uint64(base)
    if k <= 12:
        for j in range(k):
            out = out * b + codes[j : j + n]
        return mix(out)
    powers = np.cumprod(np.full(len(codes), b, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(codes), np.uint64(pow(base, -1, 1 << 64)), np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: edges (a, b) of longs -> (node, component), component the smallest node reachable.

    Every round hooks each node to its smallest neighbour, jumps pointers until they rest, and contracts the edges
    to their ends' roots, so rounds grow with the logarithm of the graph. Only minima are aggregated; no node's neighbours are
    gathered. Null ends are dropped; nodes without an edge do not appear. No edges: no rows.
    """
    least = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = cut(edges.where("a <> b").select(*least(F.col("a"), F.col("b"))).distinct(), narrow=True)
    hooks = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), narrow=True)
        while True:  # pointers rest once the last of three jumps moves none
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = hook
            for _ in range(3):
                jumped = jumped.select("node", "up").join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            jumped = cut(jumped, narrow=True)
            hook = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        hooks.append(hook)
        ends = live.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        live = cut(ends.where("ua <> ub").select(*least(F.col("ua"), F.col("ub"))).distinct(), narrow=True)
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks[0]
    for hook in hooks[1:]:
        found = found.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return cut(found, narrow=True).select("node", F.col("up").alias("component"))


#: Words of the sieve's bit table: 2^18 rows of 64 bits, a broadcast of a few MB whatever the input.
SIEVE_WORDS = 1 << 18
#: A table for many keys has more words, 16 bits a key, but no more than these: a broadcast of tens of MB.
SIEVE_MOST = 1 << 20


def sieve_words(keys: DataFrame) -> int:
    """Words of a bit table for keys, which are counted; a table of fixed size lets everything through once the keys fill it."""
    return min(SIEVE_MOST, max(SIEVE_WORDS, 1 << (keys.count() // 4).bit_length()))


def sieve(rows: DataFrame, key: str, keys: DataFrame, words: int | None = None) -> DataFrame:
    """Rows whose long column `key` may be among the one column of keys; all that are, and few others.

    A bit table of `words` (SIEVE_WORDS) is broadcast instead of the keys, so that texts which cannot match stay out of the
    shuffle of the join that follows. Null keys never pass.
    """
    bits = F.lit((words or SIEVE_WORDS) * 64)
    spot = F.pmod(F.xxhash64(F.col(keys.columns[0]).cast("long")), bits)
    table = keys.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits"))
    kept = rows.columns
    with_spot = rows.where(F.col(key).isNotNull()).withColumn("_spot", F.pmod(F.xxhash64(F.col(key).cast("long")), bits)).withColumn("_word", F.shiftright("_spot", 6))
    return with_spot.join(F.broadcast(table), "_word").where(F.expr("(shiftrightunsigned(_bits, cast(_spot & 63 as int)) & 1) = 1")).select(*kept)


def stars(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed (k, node): each key's smallest node where it has several, and (k, node, pivot) of those keys.

    Only minima and maxima are aggregated, before the shuffle as well, so a key that a third of all nodes share is
    no heavier than another.
    """
    several = keyed.groupBy("k").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top").drop("top")
    return several, keyed.join(several, "k")


def sized_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold at most `rows` narrow rows; df itself otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rare_pairs(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose sets (node, c, s) may have a Jaccard similarity of numerator / denominator.

    All that have it, each once, and few others, by prefixes: two such sets share an element of their n - ceil(t * n) + 1
    first ones in one order of all elements. Elements of a single component come first, then the rarest ones, so what
    many sets hold in common brings nobody together. A pair is found at the first element that it shares, where
    the sizes of what follows must still allow the similarity. s has distinct longs and no nulls; a node has one row.
    """
    each = sets.select("node", "c", F.size("s").alias("n"), F.explode("s").alias("x"))
    apart = lambda rows, *more: rows.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *more).where("lo < hi").drop("lo", "hi")
    often = cut(apart(each, F.count("*").alias("w")))
    mine = sieve(each, "x", often.select("x")).join(often, "x").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("w", "x"))).alias("o"))
    own = F.col("n") - F.size("o")
    length = F.col("n") - F.floor((F.col("n") * numerator + (denominator - 1)) / denominator).cast("int") + 1
    mine = mine.select("node", "c", "n", own.alias("own"), F.slice("o", 1, F.greatest(F.lit(0), length - own)).alias("o"))
    first = cut(mine.select("node", "c", "n", "own", F.posexplode("o").alias("at", "e")).select("node", "c", "n", (F.col("own") + F.col("at")).alias("at"), F.col("e.x").alias("x")))
    shared = first.join(cut(apart(first)), "x").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("o"))
    posted = shared.select("node", "c", "n", F.posexplode("o").alias("i", "e"), F.col("o.x").alias("xs"))
    posted = cut(posted.select(F.col("e.x").alias("x"), "node", "c", "n", F.col("e.at").alias("at"), F.slice("xs", F.lit(1), F.col("i")).alias("before")))
    side = lambda name: posted.select("x", F.col("node").alias(name), *(F.col(x).alias(f"{x}_{name}") for x in ("c", "n", "at", "before")))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    may = most * (numerator + denominator) >= (F.col("n_a") + F.col("n_b")) * numerator
    return side("a").join(side("b"), "x").where((F.col("c_a") < F.col("c_b")) & may & ~F.arrays_overlap("before_a", "before_b")).select("a", "b")
