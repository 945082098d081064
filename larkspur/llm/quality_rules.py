"""Quality rules: fixed base rules, then robust multivariate outliers by minimum covariance determinant.

Each (lang, source) group gets its own centre and scatter. The estimate is the deterministic form of the method, from
two starts: coordinatewise medians and spreads, and the scatter of the directions in which rows lie from the medians.
Concentration steps keep the `SHARE` of rows with the smallest Mahalanobis distance until no determinant falls any
more; the start with the smaller determinant is taken, and one reweighting step follows. A step never gathers a group: rows are summed into
(group, distance bucket) moments before the shuffle, and the smallest buckets that hold the share give the next
estimate, so a group with a third of all rows costs no more than a small one. A determinant says little about a few
rows, so every estimate is one of the group's own rows and of `PRIOR` rows' weight of its language's, and a language's
of the whole table's. The rule is the same at every size: what a group's own rows weigh grows with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WordCodes, cut, load, prepare, sized_broadcast, texts_of
from larkspur.llm.textstats import COUNTS, SHARES, text_stats

#: The transformed statistics, and the least spread that each is taken to have, so that a statistic which nearly all
#: clean texts share exactly (no symbols, no repeated line) does not make every other value an outlier.
FLOORS = {"log_word_length": 0.06, "symbols": 0.005, "dup_lines": 0.2, "repeats": 0.2, "upper": 0.06, "log_line_words": 0.5}
P = len(FLOORS)
SHARE, TAIL = 0.75, 1e-7
#: Rows that the estimate of the level above counts as.
PRIOR = 100
#: Concentration steps at most, and the change in the logarithm of a determinant that counts as none.
STEPS, STILL = 12, 1e-2
MIN_WORDS, MAX_REPEATED = 50, 50


def transformed(shares: np.ndarray) -> np.ndarray:
    s = {k: shares[:, j] for j, k in enumerate(SHARES)}
    return np.stack([np.log(np.maximum(s["word_length"], 0.5)), s["symbols"], s["dup_lines"], s["repeats"], np.sqrt(s["upper"]), s["line_words"]], axis=1)


def statistics_udf():
    kind = pa.struct([*((c, pa.int64()) for c in COUNTS), *((f"z{i}", pa.float64()) for i in range(P))])
    cache = WordCodes()

    @F.arrow_udf(", ".join([*(f"{c} long" for c in COUNTS), *(f"z{i} double" for i in range(P))]).join(["struct<", ">"]).replace(" long", ":long").replace(" double", ":double"))
    def stats(text: pa.Array) -> pa.Array:
        counts, shares = text_stats(texts_of(text), cache)
        z = transformed(shares)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in counts.T.copy()), *(pa.array(c) for c in z.T.copy())], fields=list(kind))

    return stats.asNondeterministic()


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma of (k/2, x/2) by its series."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def estimate(n: np.ndarray, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse scatter of the buckets (in order of distance) that hold `share` of the rows."""
    want = share * n.sum()
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    part = np.clip((want - before) / np.maximum(n, 1), 0, 1)
    total = max((part * n).sum(), 1.0)
    centre = (part[:, None] * sums).sum(0) / total
    square = np.zeros((P, P))
    square[np.triu_indices(P)] = (part[:, None] * products).sum(0) / total
    square = square + square.T - np.diag(np.diag(square))
    shrunk = chi2_cdf(chi2_quantile(share, P), P + 2) / share
    scatter = (square - np.outer(centre, centre)) / max(shrunk, 1e-3) + np.diag(np.square(list(FLOORS.values())))
    return centre, np.linalg.inv(scatter)


def distance(prefix: str = "") -> F.Column:
    d = [F.col(f"z{i}") - F.col("centre")[i] for i in range(P)]
    terms = [F.col("inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def keys(df: DataFrame) -> DataFrame:
    """df with _lang and _source that are never null; a null one differs from an empty one."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return df.withColumn("_lang", named("lang")).withColumn("_source", named("source"))


def fit(stats: DataFrame) -> DataFrame:
    """_lang, _source, centre, inverse for every group of stats (columns _lang, _source, base_failed, z0...)."""
    vectors = cut(stats.where("NOT base_failed").select("_lang", "_source", *(f"z{i}" for i in range(P))))
    rows = vectors.select(F.explode(F.array(*names_of())).alias("g"), *(f"z{i}" for i in range(P)))
    counts = cut(rows.groupBy("g").agg(F.count("*").alias("n")))
    mids = rows.groupBy("g").agg(*(F.percentile_approx(f"z{i}", [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(P)))
    floors = list(FLOORS.values())
    middle = F.array(*(F.col(f"q{i}")[1] for i in range(P))).alias("centre")
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(w)) for i, w in enumerate(floors)]
    scales = cut(mids.select("g", middle, F.array(*spread).alias("scale")))
    by_spread = scales.select("g", F.lit(0).alias("start"), "centre", F.array(*(F.pow(F.col("scale")[i], -2) if i == j else F.lit(0.0) for i in range(P) for j in range(P))).alias("inverse"))
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    unit = [(F.col(f"z{i}") - F.col("centre")[i]) / F.col("scale")[i] for i in range(P)]
    toward = rows.join(sized_broadcast(scales), "g").select("g", "centre", "scale", *(u.alias(f"u{i}") for i, u in enumerate(unit)))
    length = F.greatest(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(P)), F.lit(0.0)), F.lit(1e-12))
    signs = toward.groupBy("g", "centre", "scale").agg(F.count("*").alias("n"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}") / length).alias(f"p{i}_{j}") for i, j in pairs))

    def by_signs(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        square, scale = np.zeros((P, P)), np.array(row["scale"], float)
        square[np.triu_indices(P)] = P * row[[f"p{i}_{j}" for i, j in pairs]].to_numpy(float) / row["n"]
        square = (square + square.T - np.diag(np.diag(square))) * np.outer(scale, scale) + np.diag(np.square(floors))
        return pd.DataFrame({"g": [row["g"]], "start": [1], "centre": [list(row["centre"])], "inverse": [np.linalg.inv(square).ravel().tolist()]})

    kind = "g string, start int, centre array<double>, inverse array<double>"
    now = cut(by_spread.unionByName(signs.groupBy("g").applyInPandas(by_signs, kind)).withColumn("size", F.lit(None).cast("double")))
    inside = chi2_cdf(chi2_quantile(0.975, P), P)

    def step(now: DataFrame, last: bool) -> DataFrame:
        measured = rows.join(sized_broadcast(now.select("g", "start", "centre", "inverse")), "g").withColumn("_d", distance()).drop("centre", "inverse")
        if last:
            measured = measured.where(F.col("_d") <= chi2_quantile(0.975, P))
        moments = measured.groupBy("g", "start", F.floor(16 * F.log2(1 + F.greatest("_d", F.lit(0.0)))).alias("bucket")).agg(
            F.count("*").alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs)
        )
        share = inside if last else SHARE

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("bucket")
            name, start = group["g"].iloc[0], int(group["start"].iloc[0])
            n = group["n"].to_numpy(float)
            if last:  # all of these rows count; the share only sets the factor for what the cut leaves out
                n = np.array([n.sum() / share])
                group = (group.drop(columns=["g", "start", "bucket"]).sum() / share).to_frame().T
            centre, inverse = estimate(n, group[[f"s{i}" for i in range(P)]].to_numpy(float), group[[f"p{i}_{j}" for i, j in pairs]].to_numpy(float), share)
            return pd.DataFrame({"g": [name], "start": [start], "centre": [centre.tolist()], "inverse": [inverse.ravel().tolist()], "size": [-float(np.linalg.slogdet(inverse)[1])]})

        return cut(moments.groupBy("g", "start").applyInPandas(solve, f"{kind}, size double"))

    for _ in range(STEPS):
        before, now = now, step(now, False)
        moved = now.join(before.select("g", "start", F.col("size").alias("was")), ["g", "start"]).where(f"was IS NULL OR was - size > {STILL}")
        if moved.isEmpty():
            break
    best = now.groupBy("g").agg(F.min_by(F.struct("start", "centre", "inverse", "size"), F.struct("size", "start")).alias("b")).select("g", "b.*")
    own = cut(counts.join(step(cut(best), True).drop("start", "size"), "g", "left"))
    groups = vectors.select("_lang", "_source").distinct()
    for level, name in enumerate(names_of()):
        at = own.select(F.col("g").alias(f"g{level}"), *(F.col(c).alias(f"{c}{level}") for c in ("n", "centre", "inverse")))
        groups = groups.withColumn(f"g{level}", name).join(at, f"g{level}")
    return sized_broadcast(cut(groups.mapInPandas(blended, "_lang string, _source string, centre array<double>, inverse array<double>")))


def names_of() -> list[F.Column]:
    """The names of a row's groups: the whole table, its language, its language and source."""
    return [F.lit("{}"), F.to_json(F.struct("_lang")), F.to_json(F.struct("_lang", "_source"))]


def blended(batches):
    """Own estimates of a group's three levels -> its centre and inverse scatter, each level PRIOR rows of the next."""
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            centre = scatter = None
            for level in range(3):
                if row[f"centre{level}"] is None:
                    continue
                c, s = np.array(row[f"centre{level}"]), np.linalg.inv(np.array(row[f"inverse{level}"]).reshape(P, P))
                if centre is None:
                    centre, scatter = c, s
                    continue
                w = row[f"n{level}"] / (row[f"n{level}"] + PRIOR)
                scatter = w * s + (1 - w) * scatter + w * (1 - w) * np.outer(c - centre, c - centre)
                centre = w * c + (1 - w) * centre
            out.append((row["_lang"], row["_source"], None if centre is None else centre.tolist(), None if centre is None else np.linalg.inv(scatter).ravel().tolist()))
        yield pd.DataFrame(out, columns=["_lang", "_source", "centre", "inverse"])


def measured(docs: DataFrame) -> DataFrame:
    """docs with _lang, _source and the text's statistics in _s."""
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    return keys(docs).withColumn("_s", statistics_udf()(F.col("text").cast("string")))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null or empty text has zero counts, fails the base rules and has no distance. Null languages and sources are
    groups of their own. Repeated rows are judged each. A text without a fitted group (an empty table, no text
    that passes the base rules) is judged by the base rules alone.
    """
    prepare(docs.sparkSession)
    stats = cut(measured(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_lang", "_source", "_s.*").withColumn("base_failed", base_failed()))
    d = F.when(~F.col("base_failed"), distance())
    out = stats.join(fit(stats), ["_lang", "_source"], "left").withColumn("distance", d)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - TAIL, P))).alias("kept"), "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs. Texts are read twice and never shuffled."""
    prepare(docs.sparkSession)
    stats = cut(measured(docs).select("_lang", "_source", "_s.*").withColumn("base_failed", base_failed()))
    columns = docs.columns
    rows = measured(docs).join(fit(stats), ["_lang", "_source"], "left").select(*(F.col(f"`{c}`") for c in columns), "_s.*", "centre", "inverse")
    return rows.where(~base_failed() & (F.coalesce(distance(), F.lit(0.0)) <= chi2_quantile(1 - TAIL, P))).select(*(F.col(f"`{c}`") for c in columns))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))


QUERIES = {"op9_robust_outliers": op9_robust_outliers}
SQL: dict[str, str] = {}
