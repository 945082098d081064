"""Temperature mixing of sources.

A source's weight is its token share to the power of an exponent, normalised. The exponent, between 1 (shares as they
are) and 0 (all sources alike), is bisected until the weights reach a target entropy or no source is repeated more
often than a limit allows. The weights are realised as block permutations under a token budget: a source's documents
are permuted by hash and cut into blocks of about `block_tokens`; whole passes over the permutation come first, then
the blocks of one more pass as far as the budget goes, and in the block where it ends, documents in permuted order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, fresh, load, prepare, sized_broadcast

ENTROPY_SHARE, MAX_REPEATS, BLOCK_TOKENS = 0.95, 4.0, 100_000
#: Blocks of a super-block, over which their sums are added up first.
SUPER = 10_000


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    top = max(tokens.values())
    raw = {s: (n / top) ** exponent for s, n in tokens.items()}
    total = math.fsum(raw.values())
    return {s: w / total for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict[str, int], budget: float, target_entropy: float | None = None, max_repeats: float | None = None) -> tuple[float, dict[str, float]]:
    """Exponent and weights. The largest exponent whose weights reach the target entropy, raised as far as the limit asks.

    Sources without tokens are left out. A target above the largest entropy gives exponent 0, one below the entropy of
    the shares gives 1; a limit that even the shares break gives 1.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return 1.0, {}

    def bisect(holds, low: float, high: float) -> float:
        """holds at low and not at high: where that changes."""
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    rich = lambda e: entropy(weights_at(tokens, e)) >= target_entropy
    over = lambda e: max(w * budget / tokens[s] for s, w in weights_at(tokens, e).items()) > max_repeats
    exponent = 1.0 if target_entropy is None and max_repeats is None else 0.0
    if target_entropy is not None:
        exponent = 1.0 if rich(1.0) else 0.0 if not rich(0.0) else bisect(rich, 0.0, 1.0)
    if max_repeats is not None and over(exponent):
        exponent = 1.0 if over(1.0) else bisect(over, exponent, 1.0)
    return exponent, weights_at(tokens, exponent)


def words_in(column: str) -> F.Column:
    trimmed = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def mix(docs: DataFrame, budget: float | None = None, entropy_share: float | None = ENTROPY_SHARE, max_repeats: float | None = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = 7, keep_all: bool = False) -> DataFrame:
    """docs with n_tokens (words), block, copies (times that the mix holds the row) and source_weight added.

    budget is in tokens, by default those of docs; entropy_share is a share of the largest entropy that the sources
    allow. keep_all raises the budget until the source that is repeated least is held once in full. Null sources are a
    source of their own. Null and empty texts have no tokens and are held as often as their source's whole passes.
    Repeated rows are permuted each; equal ones stand together. An empty table gives no rows. A source's share of the
    budget is met but for less than one document. Only a source's totals reach the driver.
    """
    prepare(docs.sparkSession)
    n, block, copies, weight, name = (fresh(docs, x) for x in ("n_tokens", "block", "copies", "source_weight", "_source"))
    keyed = docs.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))).withColumn(n, words_in("text"))
    keyed = keyed.withColumn("_u", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.length("text")))
    counted = cut(keyed.groupBy(name, "_u").agg(F.sum(n).alias("t")))  # words are counted here and in the rows that go out, not a third time
    totals = {r[0]: r[1] or 0 for r in counted.groupBy(name).agg(F.sum("t")).collect()}  # one row a source
    live = {s: t for s, t in totals.items() if t > 0}
    total = sum(live.values())
    most = math.log(len(live)) if len(live) > 1 else 0.0
    target = None if entropy_share is None else entropy_share * most - 1e-12
    if keep_all:  # the least repeated source once in full: the budget follows from the weights, and the limit from the budget
        spread = lambda e: (lambda r: max(r) / min(r))([w / live[s] for s, w in weights_at(live, e).items()])
        exponent, shares = solve(live, total, target) if live else (1.0, {})
        if live and max_repeats is not None and spread(exponent) > max_repeats:
            low, high = exponent, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (low, mid) if spread(mid) <= max_repeats else (mid, high)
            exponent, shares = high, weights_at(live, high)
        budget = max((live[s] / w for s, w in shares.items()), default=0.0)
    else:
        budget = float(total if budget is None else budget)
        exponent, shares = solve(live, budget, target, max_repeats)
    plan = []
    for s, t in totals.items():
        want = shares.get(s, 0.0) * budget
        passes = math.floor(want / t + 1e-9) if t else 1
        plan.append((s, passes, max(0.0, want - passes * t), max(1, math.ceil(t / block_tokens)), shares.get(s, 0.0)))
    spark = docs.sparkSession
    goal = sized_broadcast(spark.createDataFrame(plan, f"`{name}` string, _passes long, _rest double, _blocks long, `{weight}` double"))  # one row a source
    dealt = lambda table: table.join(goal, name, "left").withColumn(block, F.pmod(F.xxhash64(F.lit(seed + 1), "_u"), F.col("_blocks")))
    rows, slim = dealt(keyed), dealt(counted).select(name, block, "_u", "t", "_rest")
    sums = slim.groupBy(name, block, "_rest").agg(F.sum("t").alias("_all"))  # a row a block
    sums = cut(sums.withColumn("_super", F.floor(F.col(block) / SUPER)))
    supers = sums.groupBy(name, "_super").agg(F.sum("_all").alias("_own"))  # prefix sums on two levels, so that no task has all blocks of a source
    supers = supers.select(name, "_super", (F.sum("_own").over(Window.partitionBy(name).orderBy("_super")) - F.col("_own")).alias("_base"))
    within = F.sum("_all").over(Window.partitionBy(name, "_super").orderBy(block)) - F.col("_all")
    sums = sums.join(supers, [name, "_super"]).withColumn("_left", F.col("_rest") - F.col("_base") - within)
    sums = cut(sums.drop("_rest", "_base", "_super").where(F.col("_left") > 0))
    whole = sums.where(F.col("_all") <= F.col("_left")).select(name, block, F.lit(True).alias("_in"))
    ending = sums.where(F.col("_all") > F.col("_left"))  # at most one block a source
    run = F.sum("t").over(Window.partitionBy(name, block).orderBy("_u"))
    part = cut(slim.join(sized_broadcast(ending), [name, block]).withColumn("_run", run).where(F.col("_run") <= F.col("_left")).select(name, block, "_u", F.lit(True).alias("_extra")))
    out = rows.join(sized_broadcast(whole), [name, block], "left").join(sized_broadcast(part), [name, block, "_u"], "left")
    extra = F.when(F.col("_in") | F.col("_extra"), 1).otherwise(0)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), n, block, (F.col("_passes") + extra).alias(copies), weight)


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of docs as often as mix() holds it, with the columns of docs."""
    mixed = mix(docs, **settings)
    copies = mixed.columns[-2]
    again = F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))).alias(fresh(mixed, "_again"))
    return mixed.select("*", again).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", "block", "copies", "source_weight")


QUERIES = {"op5_temperature_mixing": op5_temperature_mixing}
SQL: dict[str, str] = {}
