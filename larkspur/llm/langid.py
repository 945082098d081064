"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import load, prepare, texts_of

#: Families of closely related languages by ISO code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
}
#: Most rows fitted on: a language, and in all; more are thinned to this by hash.
FIT_ROWS_LANGUAGE, FIT_ROWS = 500, 6000
TRIGRAMS, BIGRAMS, SINGLES = 4096, 1024, 256
WIDTH = TRIGRAMS + BIGRAMS + SINGLES
FOLDS, HELD_OUT = 3, 1

#: ASCII letters to lower case, other ASCII to a space; bytes of other letters stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def vectors(texts: list[bytes]) -> np.ndarray:
    """Square roots of hashed counts of one to three bytes, each row of length one (zero for an empty text)."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):  # whole text, in runs that bound the memory
            b = _FOLD[np.frombuffer(text[at : at + (1 << 20) + 2], np.uint8)].astype(np.uint32)
            two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
            last = at + (1 << 20) >= len(text)
            m = len(b) if last else 1 << 20
            out[i, TRIGRAMS + BIGRAMS :] += np.bincount(b[:m], minlength=SINGLES)
            out[i, TRIGRAMS : TRIGRAMS + BIGRAMS] += np.bincount(two[:m] >> np.uint32(22), minlength=BIGRAMS)
            out[i, :TRIGRAMS] += np.bincount(three[:m] >> np.uint32(20), minlength=TRIGRAMS)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by accelerated gradient steps; y is 1 or -1, classes count alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 + 4 * c)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * c * (x.T @ (weight * y * slack)))
        w, v = new, new + k / (k + 3) * (new - w)
    return w[:-1], float(w[-1])


@dataclass
class Hierarchy:
    families: list[list[str]]
    family_weights: np.ndarray
    family_bias: np.ndarray
    within: dict[int, tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.family_weights.T + self.family_bias
        top = margins.argmax(1)
        exp = np.exp(4 * (margins - margins.max(1, keepdims=True)))
        score = exp[np.arange(len(x)), top] / exp.sum(1)
        langs = [self.families[k][0] for k in top]
        for k, (pairs, weights, bias) in self.within.items():
            own = np.flatnonzero(top == k)
            if not len(own):
                continue
            m = x[own] @ weights.T + bias
            votes = np.zeros((len(own), len(self.families[k])))
            for j, (a, b) in enumerate(pairs):
                sure = 1 / (1 + np.exp(-4 * m[:, j]))
                votes[:, a] += (m[:, j] > 0) + 1e-3 * sure
                votes[:, b] += (m[:, j] <= 0) + 1e-3 * (1 - sure)
            best = votes.argmax(1)
            for i, row in enumerate(own):
                langs[row] = self.families[k][best[i]]
                mine = [1 / (1 + np.exp(-4 * m[i, j] * (1 if a == best[i] else -1))) for j, (a, b) in enumerate(pairs) if best[i] in (a, b)]
                score[row] *= min(mine)
        return langs, np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy | None:
    known = sorted(set(langs))
    if not known:
        return None
    of = {code: family for family, codes in FAMILIES.items() for code in codes}
    names = sorted({of.get(code, f"={code}") for code in known})
    families = [[code for code in known if of.get(code, f"={code}") == name] for name in names]
    langs = np.array(langs)
    member = np.array([names.index(of.get(code, f"={code}")) for code in langs])
    if len(families) == 1:
        weights, bias = np.zeros((1, WIDTH), np.float32), np.zeros(1, np.float32)
    elif len(families) == 2:
        w, b = svm(x, np.where(member == 0, 1, -1).astype(np.float32))
        weights, bias = np.stack([w, -w]), np.array([b, -b])
    else:
        fits = [svm(x, np.where(member == k, 1, -1).astype(np.float32)) for k in range(len(families))]
        weights, bias = np.stack([w for w, _ in fits]), np.array([b for _, b in fits])
    within = {}
    for k, codes in enumerate(families):
        pairs = list(combinations(range(len(codes)), 2))
        if pairs:
            fits = []
            for a, b in pairs:
                own = (langs == codes[a]) | (langs == codes[b])
                fits.append(svm(x[own], np.where(langs[own] == codes[a], 1, -1).astype(np.float32)))
            within[k] = (pairs, np.stack([w for w, _ in fits]), np.array([b for _, b in fits]))
    return Hierarchy(families, weights, bias, within)


def fold(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, rows_language: int = FIT_ROWS_LANGUAGE, rows: int = FIT_ROWS) -> Hierarchy | None:
    """Fit on at most about `rows_language` texts a language and `rows` in all, of documents outside the held-out fold."""
    prepare(docs.sparkSession)
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(fold() != HELD_OUT)
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, min(rows_language, rows // len(counts)))
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    chosen = usable.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), draw.alias("draw")).where(F.col("draw") < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        for batch in batches:
            v = vectors(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in v], pa.binary())], ["lang", "v"])

    got = sorted((r["lang"], bytes(r["v"])) for r in chosen.mapInArrow(run, "lang string, v binary").limit(2 * rows).collect())
    return fit(np.stack([np.frombuffer(v, np.float32) for _, v in got]) if got else np.empty((0, WIDTH)), [code for code, _ in got])


def has_letter(text: bytes) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. Null, empty and letterless texts are `und` with score 0.

    Without anything to learn from, all rows are `und`. Repeated rows are predicted each.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                got, sure = model.predict(vectors([texts[i] for i in part]))
                for i, code, s in zip(part, got, sure, strict=True):
                    langs[i], scores[i] = code, s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
