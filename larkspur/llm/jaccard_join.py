"""N-gram Jaccard join in the size-aware, heavy-light manner.

Small sets enumerate subsets of a fixed size: a pair at the threshold shares at least `SUBSET` shingles of the two
prefixes (in hash order), so all `SUBSET`-subsets of a prefix are index keys and no link is lost. Large sets would
have too many; they post under `BANDS` keys, each the hash of `TUPLE` min-wise shingles, and the inverted lists of
those keys are scanned. A list under a single shingle would be as long as the shingle is common; under a tuple, a
pair at the threshold is missed with probability 5e-13 and common lines or passages bring nobody together. The
boundary is the size at which the index has the fewest rows, by the sizes that the table holds; sets just below it
post both ways.

Equal sets are one class. The classes of a list are held against one of them, exactly; classes of a list that verified
links have not brought into one component by then meet pair by pair, those of long lists by their rarest shingles, which
every pair that links shares (`rare_pairs`). Nothing is chained by what has not been verified.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, partial
from itertools import combinations
from math import ceil, comb, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WordCodes, components, cut, load, mix, prepare, rare_pairs, sieve, signed, stars, texts_of, window_hashes, word_codes

GRAM, LINK = 4, 85
SUBSET, BANDS, TUPLE = 3, 64, 6
#: Largest boundary that is weighed: beyond it a set would enumerate thousands of subsets.
MOST_SMALL = 160
#: Classes of longer lists meet another of their classes up to STAR_ROUNDS times, then by their rarest shingles if over BLOCK classes are left.
LONG, BLOCK, STAR_ROUNDS = 12, 256, 3
#: Classes that are held against one class in a task.
SHARE = 500


def odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Sets of `gram` words link at a Jaccard similarity of `link` hundredths or more; bands follow from that, the boundary from the data."""

    gram: int = GRAM
    link: int = LINK
    small: int = 0  #: largest set size that enumerates subsets; 0: the least costly where all sizes are alike frequent

    def __post_init__(self):
        if not self.small:
            object.__setattr__(self, "small", self.cheapest({n: 1 for n in range(1, MOST_SMALL + 1)}))

    def subsets(self, n: int) -> int:
        return comb(min(n, self.prefix_length(n)), SUBSET) if n >= self.alone else 0

    def cheapest(self, sizes: dict[int, int]) -> int:
        """The boundary at which sets of these sizes (size -> number) have the fewest index rows."""
        large = {x: sum(c for n, c in sizes.items() if 100 * n >= self.link * x) * self.bands for x in range(self.alone, MOST_SMALL + 1)}
        cost, spent = {}, 0
        for x in large:
            spent += sizes.get(x, 0) * self.subsets(x)
            cost[x] = spent + large[x]
        return min(cost, key=lambda x: (cost[x], x))

    def prefix_length(self, n: int) -> int:
        return n - -(-self.link * n // 100) + SUBSET

    @cached_property
    def alone(self) -> int:
        """Below this size only equal sets reach the threshold."""
        return next(n for n in range(1, 1000) if 100 * n >= self.link * (n + 1))

    @cached_property
    def bands(self) -> int:
        """Lists a set: as many as keep a pair at the threshold from being missed as rarely as BANDS do at LINK."""
        missed = BANDS * log1p(-((LINK / 100) ** TUPLE))
        return max(1, ceil(missed / log1p(-((self.link / 100) ** TUPLE)) - 1e-9))


OWN = Rule()
SMALL, ALONE = OWN.small, OWN.alone


def shingle_set(text: bytes, cache: WordCodes, gram: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, A-Z lower-cased; one for the whole of a shorter text, none without words."""
    codes = word_codes(text.lower().split(), cache)
    if 0 < len(codes) < gram:
        return mix(window_hashes(codes, len(codes)) ^ np.uint64(len(codes)))
    return np.unique(window_hashes(codes, gram))


def index_keys(s: np.ndarray, rule: Rule = OWN) -> np.ndarray:
    """Keys of a set; sets at or over the threshold share one."""
    n, out = len(s), []
    if rule.alone <= n <= rule.small:
        take = np.array(list(combinations(range(min(n, rule.prefix_length(n))), SUBSET)))
        out.append(mix(mix(mix(s[take[:, 0]]) + s[take[:, 1]]) + s[take[:, 2]]))
    if n * 100 >= rule.link * rule.small:
        factors = odd(rule.bands * TUPLE)
        least = np.full(rule.bands * TUPLE, ~np.uint64(0))
        for at in range(0, n, 2048):
            least = np.minimum(least, (factors[:, None] * s[None, at : at + 2048]).min(1))
        band = mix(np.arange(10_001, 10_001 + rule.bands, dtype=np.uint64))
        out.append(mix((mix(least.reshape(rule.bands, TUPLE)) * factors[None, :TUPLE]).sum(1, dtype=np.uint64) + band))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def fitted(docs: DataFrame, gram: int, link: int) -> Rule:
    """The rule whose boundary costs least on docs, by their numbers of words (cut at spaces; an estimate, which only the cost depends on)."""
    rule = Rule(gram, link)
    words = F.size(F.split(F.trim(F.col("text").cast("string")), " "))
    sizes = docs.select(F.greatest(F.lit(1), F.least(F.lit(2 * MOST_SMALL), words - (gram - 1))).alias("n")).groupBy("n").agg(F.count("*").alias("c")).collect()  # at most 2 * MOST_SMALL rows
    counts = {r["n"]: r["c"] for r in sizes if r["n"]}
    return Rule(gram, link, rule.cheapest(counts)) if counts else rule


def signatures(docs: DataFrame, rule: Rule = OWN) -> DataFrame:
    """doc_id, t (hash of the text), n, d1, d2 (digest of the set) and keys of every row."""

    def run(batches):
        cache = WordCodes()
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for text in texts_of(batch.column(2)):
                s = shingle_set(text, cache, rule.gram)
                n.append(len(s))
                d1.append(int(signed(mix(s).sum(dtype=np.uint64, keepdims=True))[0]))
                d2.append(int(signed(mix(s * np.uint64(3) + np.uint64(7)).sum(dtype=np.uint64, keepdims=True))[0]))
                keys.append(signed(index_keys(s, rule)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "n", "d1", "d2", "keys"])

    prepare(docs.sparkSession)
    return keyed_texts(docs).mapInArrow(run, "doc_id long, t long, n long, d1 long, d2 long, keys array<long>")


def against_heads(batches, rule: Rule = OWN):
    """Rows sorted by (a, part, b), the head's own with b null first: (a, part, b, text) -> links of the head with b."""
    cache, head = WordCodes(), np.empty(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for i, j, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(3)), strict=True):
            s = shingle_set(text, cache, rule.gram)
            if j is None:
                head = s
                continue
            both = len(np.intersect1d(head, s, assume_unique=True))
            if both and 100 * both >= rule.link * (len(head) + len(s) - both):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. A head a with many partners is dealt out in parts, its text to each."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b").join(texts.withColumnRenamed("node", "b"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("node", "a"), "a")
    rows = others.select("a", "part", "b", "text").unionByName(heads.select("a", "part", F.lit(None).cast("long").alias("b"), "text"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(partial(against_heads, rule=rule), "a long, b long")


def sets_of(nodes: DataFrame, rule: Rule) -> DataFrame:
    """node, c and the set s of the rows (node, c, text), a few hundred thousand shingles a batch."""

    def run(batches):
        cache = WordCodes()
        for batch in batches:
            at, found, held = 0, [], 0
            for i, text in enumerate(texts_of(batch.column(2)), 1):
                found.append(signed(shingle_set(text, cache, rule.gram)))
                held += len(found[-1])
                if held > 200_000 or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at:i], batch.column(1)[at:i], pa.array(found, pa.list_(pa.int64()))], ["node", "c", "s"])
                    at, found, held = i, [], 0

    return nodes.mapInArrow(run, "node long, c long, s array<long>")


def linked_classes(members: DataFrame, texts: DataFrame, rule: Rule, more: DataFrame) -> DataFrame:
    """(node, component) by all links between members (k, node, n) of one list, and by the links (a, b) of more."""
    rest, links = members.withColumn("c", F.col("node")), more
    for r in range(STAR_ROUNDS):
        heads = rest.groupBy("k").agg(F.min_by(F.struct("node", "c"), F.xxhash64("node") if r else F.col("node")).alias("head"), F.count("*").alias("size"))
        if r:
            heads = cut(heads.where(F.col("size") > LONG), narrow=True)
            if heads.isEmpty():
                break
        pairs = cut(rest.join(heads, "k").where("c <> head.c").select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), narrow=True)
        links = cut(links.unionByName(verified(pairs, texts, rule)), narrow=True)
        parts = components(links)
        named = members.join(parts, "node", "left").select("k", "node", "n", F.coalesce("component", "node").alias("c"))
        still = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi AND size > 2").select("k", "size")
        rest = cut(named.join(still, "k"), narrow=True)
    if rest.isEmpty():
        return parts
    long = rest.where(F.col("size") > LONG).select("node", "c").distinct()
    rare = long.count() > BLOCK
    few = rest.where(F.col("size") <= LONG) if rare else rest
    side = lambda x: few.select("k", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "c")))
    near = (F.col("n_a") * 100 >= F.col("n_b") * rule.link) & (F.col("n_b") * 100 >= F.col("n_a") * rule.link)
    pairs = side("a").join(side("b"), "k").where((F.col("c_a") < F.col("c_b")) & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    if rare:
        pairs = pairs.unionByName(rare_pairs(cut(sets_of(long.join(texts, "node").select("node", "c", "text"), rule)), rule.link, 100))
    found = cut(verified(cut(pairs.distinct()), texts, rule))
    return parts if found.isEmpty() else components(links.unionByName(found))


def join(docs: DataFrame, gram: int = GRAM, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are ignored).

    Texts link whose sets of `gram` words have a Jaccard similarity of `link` hundredths or more.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts, and texts
    without words, have no shingles and link with nothing. Rows that share a doc_id are one node of the graph, with
    the links of all their texts; a row without words still has its own doc_id. A null doc_id takes part under no name: its row has a null component_id. An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    rule = fitted(docs, gram, link)
    sets = cut(signatures(docs, rule))
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "t")).alias("first")))
    classes = cut(classes.select("d1", "d2", "n", "first.doc_id", "first.t", F.monotonically_increasing_id().alias("node")))
    firsts = named.join(classes.select("d1", "d2", "n", "doc_id", "t", "node"), ["d1", "d2", "n", "doc_id", "t"]).select("node", "n", "keys").dropDuplicates(["node"])
    keyed = firsts.select(F.explode("keys").alias("k"), "node", "n")
    members = cut(stars(keyed)[1].select("k", "node", "n"), narrow=True)
    searched = cut(members.select("node").distinct().join(classes, "node").select("node", "doc_id", "t"), narrow=True)
    texts = cut(sieve(keyed_texts(docs), "doc_id", searched.select("doc_id")).join(searched, ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"]))
    of_class = classes.select("d1", "d2", "n", "node")
    several = named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n")).alias("lo"), F.max(F.struct("d1", "d2", "n")).alias("hi")).where("lo <> hi").select("doc_id")
    shared = cut(named.join(cut(several), "doc_id").join(of_class, ["d1", "d2", "n"]).select(F.col("doc_id").alias("k"), "node").distinct())
    same_doc = stars(shared)[1].where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    parts = linked_classes(members, texts, rule, cut(same_doc, narrow=True))
    parts = cut(classes.join(parts, "node", "left").select("d1", "d2", "n", "doc_id", F.coalesce("component", "node").alias("c")))
    least = parts.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    found = parts.join(least, "c").select("d1", "d2", "n", "component_id")
    out = sets.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, gram: int = GRAM, link: int = LINK) -> DataFrame:
    """Rows of docs that are the first of their component, with the columns of docs; texts without shingles all stay."""
    found = cut(join(docs, gram, link))
    dead = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_dead")).distinct()
    key = F.col("doc_id").cast("long")
    return docs.join(dead, key == F.col("_dead"), "left_anti")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
SQL: dict[str, str] = {}
