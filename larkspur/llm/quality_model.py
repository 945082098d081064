"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature (then one pair) after the other and adds a shallow tree over that feature's bins,
so the model is a lookup table a feature and a grid a pair. A text is scored by adding the entries of its bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WordCodes, load, prepare, texts_of
from larkspur.llm.textstats import SHARES, text_stats

FEATURES = ("log_words", *SHARES)
#: Most labelled rows that are fitted on; more are thinned to this by hash.
FIT_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 250, 120, 6, 0.1
THRESHOLD, FOLDS = 0.3, 5


def features(texts: list[bytes], cache: WordCodes) -> np.ndarray:
    counts, shares = text_stats(texts, cache)
    return np.column_stack([np.log1p(counts[:, 0]), shares])


def leaves(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Newton steps of a tree of depth two over ordered bins."""

    def split(lo: int, hi: int) -> int | None:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return None
        gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
        gain[(ch[:-1] < least) | (ch[-1] - ch[:-1] < least)] = -1
        k = int(gain.argmax())
        return lo + k + 1 if gain[k] > 1e-9 else None

    out = np.zeros(len(g))
    cuts = [0, len(g)]
    for _ in range(2):
        cuts = sorted({*cuts, *(c for a, b in zip(cuts, cuts[1:], strict=False) if (c := split(a, b)))})
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def grid_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut on one axis and one on the other: four leaves. Also the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H = cg[-1, -1], ch[-1, -1]
    a, b, c = cg[:-1, :-1], cg[:-1, -1:], cg[-1:, :-1]
    x, y, z = ch[:-1, :-1], ch[:-1, -1:], ch[-1:, :-1]
    score = a**2 / (x + 1) + (b - a) ** 2 / (y - x + 1) + (c - a) ** 2 / (z - x + 1) + (G - b - c + a) ** 2 / (H - y - z + x + 1)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out, float(score[i, j] - G**2 / (H + 1))


@dataclass
class Additive:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: one table entry a feature, one grid entry a pair, added up."""
        f = np.full(len(x), self.bias)
        for j, edges in enumerate(self.edges):
            f += self.tables[j][np.searchsorted(edges, x[:, j], "right")]
        for a, b, grid in self.pairs:
            f += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost on rows x with labels y (0 or 1). No rows: a model that scores one half; one class: its smoothed share."""
    n, d = len(x), len(FEATURES)
    edges_of = lambda j, k: np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if n else np.empty(0)
    edges, coarse = [edges_of(j, BINS) for j in range(d)], [edges_of(j, PAIR_BINS) for j in range(d)]
    share = (y.sum() + 1) / (n + 2)
    model = Additive(edges, coarse, np.zeros((d, BINS + 1)), [], float(np.log(share / (1 - share))))
    if not 0 < y.sum() < n:
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    f = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * leaves(np.bincount(bins[j], g, BINS + 1), np.bincount(bins[j], h, BINS + 1), 2.0)
            model.tables[j] += step
            f += step[bins[j]]
    boxes = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    flat = lambda a, b: boxes[a] * PAIR_BINS + boxes[b]
    sums = lambda a, b, v: np.bincount(flat(a, b), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = sorted(((grid_leaves(sums(a, b, g), sums(a, b, h))[1], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, grid in model.pairs:
            g, h = slopes()
            step = RATE * grid_leaves(sums(a, b, g), sums(a, b, h))[0]
            grid += step
            f += step.ravel()[flat(a, b)]
    return model


def fold(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Additive:
    """Fit on at most `rows` labelled texts whose fold is not 0, chosen by a hash of doc_id."""
    prepare(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(fold() != 0)
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # at most `rows` pairs of numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("quality", "text")

    def run(batches):
        cache = WordCodes()
        for batch in batches:
            x = features(texts_of(batch.column(1)), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T.copy())], ["quality", *FEATURES])

    got = texts.mapInArrow(run, "quality int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    got = got.sort_values(["quality", *FEATURES])
    return fit(got[list(FEATURES)].to_numpy(float), (got["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored as texts without words."""

    def run(batches):
        cache = WordCodes()
        for batch in batches:
            s = model.score(features(texts_of(batch.column(1)), cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_gam": op7_quality_gam}
SQL: dict[str, str] = {}
