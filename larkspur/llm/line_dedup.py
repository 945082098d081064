"""Fuzzy line deduplication with DataFrame functions alone.

Lines that are equal after trimming and lower-casing are one node. A node's shingles are the runs of `SHINGLE`
characters at every position. MinHash signatures are banded; of lines that have enough of them, the signature sees only
the shingles that begin with one of the letters of `MARKS` (a choice by content, alike in all lines), of all others
every shingle. Verification always compares the full sets. In each band a bucket's lines are held against one of them;
what a small bucket still holds in different components is compared pair by pair. Lines of large buckets meet by their rarest
shingles, which every similar pair shares (`rare_pairs`), so no pair of lines that share a band is left out and what a bucket's lines
all have in common makes no pairs. Verified links go through a distributed union-find, and the first line of each component stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import components, cut, fresh, load, prepare, rare_pairs, settings, sieve, sieve_words, stars

SHINGLE, BANDS, ROWS = 9, 8, 3
#: First characters of the shingles that the signature of a long line sees; about a quarter of Latin text.
MARKS = "aei"
#: Lines of at least SEEN marked shingles have keys by these, those under UNSEEN by all; similar lines share a kind.
SEEN, UNSEEN = 24, 36
#: Buckets of more nodes meet another of their nodes, up to STAR_ROUNDS times in all, before what is left meets otherwise.
LARGE, STAR_ROUNDS = 16, 3
#: Up to so many nodes of large buckets in all meet pair by pair too.
BLOCK = 128
#: Evenly spaced, one a band. The ROWS shingle hashes at and after a pivot, going round at the end, are its MinHashes.
PIVOTS = [(j << 64) // BANDS - (1 << 63) for j in range(BANDS)]
#: The signature's expressions together are more than the JVM compiles as one method; over this size they are split.
SPLIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
BLANK = " \t\r\x0b\f"
#: Links at a Jaccard similarity of 4/5 or more. At that similarity a pair shares a band with probability 0.996 or more
#: from five shingles on, by simulation.
NUMERATOR, DENOMINATOR = 4, 5


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line (number), h (node), norm of every line that has a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))  # t once a row, not once a line
    each = rows.select("doc_id", "t", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    norm = F.lower(F.btrim("raw", F.lit(BLANK)))
    return each.where(F.col("raw").rlike(rf"[^{BLANK}]")).select("doc_id", "t", "line", norm.alias("norm")).withColumn("h", F.xxhash64("norm"))


def marked(norm: str) -> F.Column:
    """Hashes of the runs of SHINGLE characters that begin with one of MARKS, at every position; they may repeat."""
    found = F.regexp_extract_all(F.col(norm), F.lit(rf"(?s)[{MARKS}](?<=(?=(.{{{SHINGLE}}}))[{MARKS}])"), F.lit(1))
    return F.transform(found, lambda x: F.xxhash64(x))


def shingles(norm: str = "norm") -> F.Column:
    """Hashes of the distinct runs of SHINGLE characters at every position; a shorter line is one run.

    Runs are cut from the line's UTF-32 bytes, four a character, which takes a third of the time of a regular expression.
    """
    wide = 4 * SHINGLE
    cuts = lambda x: F.transform(F.sequence(F.lit(1), F.octet_length(x) - (wide - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(x, i, F.lit(wide))))
    hashes = lambda x: F.when(F.octet_length(x) < wide, F.array(F.xxhash64(x))).otherwise(cuts(x))
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(norm, "UTF-32")), hashes)))  # the lambda encodes once, not once a run


def band_keys(lines: DataFrame, norm: str = "norm") -> DataFrame:
    """lines with keys, those of the bands: at a pivot, the next ROWS hashes of the line's set in order.

    A line whose marked shingles are about as many as ask for either set has a row for each; main marks one of them.
    """
    found = lines.withColumn("m", marked(norm))
    found = found.withColumn("s", F.when(F.size("m") < UNSEEN, shingles(norm))).withColumn("m", F.when(F.size("m") >= SEEN, F.array_distinct("m")))
    found = found.select(*lines.columns, F.col("m").isNull().alias("few"), F.posexplode(F.array("m", "s")).alias("pos", "x")).where("x IS NOT NULL")
    both = F.sort_array(F.concat("x", F.array(*map(F.lit, PIVOTS))))
    found = found.select("*", F.sort_array("x").alias("ordered"), both.alias("marked"), F.size("x").alias("n"))
    found = found.withColumn("ordered", F.concat("ordered", F.slice("ordered", 1, ROWS - 1)))
    after = lambda j, p: (F.array_position("marked", F.lit(p)).cast("int") - 1 - j) % F.col("n")
    keys = F.array(*(F.xxhash64(F.lit(j), F.slice("ordered", after(j, p) + 1, F.lit(ROWS))) for j, p in enumerate(PIVOTS)))
    return found.select(*lines.columns, keys.alias("keys"), ((F.col("pos") == 0) | F.col("few")).alias("main"))


def alike(a: str | F.Column, b: str | F.Column) -> F.Column:
    """Exactly |a & b| / |a | b| >= 4/5 over arrays of distinct shingles."""
    na, nb = F.size(a), F.size(b)
    sizes = (na * DENOMINATOR >= nb * NUMERATOR) & (nb * DENOMINATOR >= na * NUMERATOR)
    return sizes & (F.size(F.array_intersect(a, b)) * (NUMERATOR + DENOMINATOR) >= (na + nb) * NUMERATOR)


def linked(pairs: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, na, nb) whose lines na and nb are alike.

    Each line is cut once: a filter on the two sets would move before the cuts and repeat them, but it stays after an explode.
    """
    sets = pairs.select("a", "b", shingles("na").alias("sa"), shingles("nb").alias("sb"))
    both = sets.select("a", "b", F.explode(F.array(F.struct("sa", "sb"))).alias("both"))
    return both.where(alike(F.col("both.sa"), F.col("both.sb"))).select("a", "b")


def told_apart(seen: DataFrame) -> DataFrame:
    """seen with nodes of their own for different lines whose 64-bit hashes are equal: h goes with a second hash g."""
    clash = cut(seen.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h"))
    if clash.isEmpty():
        return seen
    mixed = seen.join(clash.withColumn("clash", F.lit(True)), "h", "left")
    return cut(mixed.withColumn("h", F.when(F.col("clash"), F.xxhash64("h", "g")).otherwise(F.col("h"))).drop("clash"))


def spelled_sets(rest: DataFrame, text: DataFrame) -> DataFrame:
    """node, c and the shingles s of the members (k, node, c) of buckets, a row a node."""
    return cut(rest.select("node", "c").distinct().join(text.withColumnRenamed("h", "node"), "node").select("node", "c", shingles().alias("s")))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, t, drop: numbers of the lines of a document that a line before them (by doc_id, then number) makes redundant."""
    prepare(docs.sparkSession)
    lines = band_keys(lines_of(docs).withColumn("g", F.xxhash64(F.lit(1), "norm")))
    with settings(docs.sparkSession, SPLIT):
        seen = cut(lines.select("doc_id", "t", "line", "h", "g", "keys", "main"))
    seen = told_apart(seen)
    keyed = seen.select(F.explode("keys").alias("k"), F.col("h").alias("node"))
    seen = seen.where("main").select("doc_id", "t", "line", "h")
    several = cut(stars(keyed)[0].select("k"), narrow=True)
    members = cut(sieve(keyed, "k", several, sieve_words(several)).join(several, "k").distinct(), narrow=True)
    nodes = members.select("node").distinct()
    spelled = sieve(lines_of(docs).select("h", "norm"), "h", nodes, sieve_words(nodes))
    text = cut(spelled.distinct())
    side = lambda name, norm: text.select(F.col("h").alias(name), F.col("norm").alias(norm))
    verified = lambda pairs: linked(pairs.join(side("a", "na"), "a").join(side("b", "nb"), "b"))
    least = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest, links, tried, parts = members.withColumn("c", F.col("node")), None, None, None
    for r in range(STAR_ROUNDS):
        heads = rest.groupBy("k").agg(F.min_by(F.struct("node", "c"), F.xxhash64("node", "k", F.lit(r))).alias("head"), F.count("*").alias("n"))
        if r:
            heads = cut(heads.where(F.col("n") > LARGE), narrow=True)
            if heads.isEmpty():
                break
        edges = rest.join(heads, "k").where("c <> head.c").select(F.col("head.node").alias("a"), F.col("node").alias("b")).select(*least).distinct()
        edges = cut(edges if tried is None else edges.join(tried, ["a", "b"], "left_anti"), narrow=True)
        found = verified(edges)
        links = cut(found if links is None else links.unionByName(found), narrow=True)
        tried = edges if tried is None else tried.unionByName(edges)
        parts = components(links)
        named = members.join(parts, "node", "left").select("k", "node", F.coalesce("component", "node").alias("c"))
        still = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi AND n > 2").select("k", "n")
        rest = cut(named.join(still, "k"), narrow=True)
    if not rest.isEmpty():
        many = rest.where(F.col("n") > LARGE)
        rare = many.select("node").distinct().count() > BLOCK
        few = rest.where(F.col("n") <= LARGE) if rare else rest
        left, right = (few.select("k", F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        pairs = left.join(right, "k").where("ca < cb").select(*least)
        if rare:
            pairs = pairs.unionByName(rare_pairs(spelled_sets(many, text), NUMERATOR, DENOMINATOR).select(*least))
        more = cut(verified(cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), narrow=True)))
        if not more.isEmpty():
            parts = components(links.unionByName(more))
    place = F.struct("doc_id", "t", "line")
    nodes = seen.groupBy("h").agg(F.min(place).alias("at"), F.count("*").alias("n")).join(parts.withColumnRenamed("node", "h"), "h", "left")
    nodes = cut(nodes.where("n > 1 OR component IS NOT NULL").select("h", "at", F.coalesce("component", "h").alias("c")))
    first = nodes.groupBy("c").agg(F.min("at").alias("first"))
    first = cut(nodes.join(first, "c").select("h", "first"), narrow=True)
    again = sieve(seen, "h", first.select("h"), sieve_words(first)).join(first, "h").where(place != F.col("first"))
    return again.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def without(parts: F.Column, drop: F.Column) -> F.Column:
    """parts without those at the sorted indices drop: the runs between them, one after the other."""
    before = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(drop, j - 1) + 1)
    after = lambda j: F.coalesce(F.get(drop, j), F.size(parts))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda j: F.slice(parts, before(j) + 1, after(j) - before(j))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with redundant lines taken out of text, n_chars (if there) brought up to date, and n_removed added.

    One line of each group of equal or similar lines stays, the first by (doc_id, text, line number). Lines without
    a word always stay. A null text stays null and an empty one empty; a row without doc_id is ordered first. Rows
    that repeat a doc_id and text keep the same lines. All other columns pass through under their names.
    """
    gone = cut(duplicates(docs))
    key, absent, text_key, drop, removed, parts = (fresh(docs, x) for x in ("_doc", "_absent", "_t", "_drop", "n_removed", "_parts"))
    gone = gone.select(F.coalesce("doc_id", F.lit(0)).alias(key), F.col("doc_id").isNull().alias(absent), F.col("t").alias(text_key), F.col("drop").alias(drop))
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(absent, F.col("doc_id").cast("long").isNull()).withColumn(text_key, F.xxhash64("text"))
    rows = rows.join(gone, [key, absent, text_key], "left")
    rows = rows.withColumn(parts, F.when(F.col(drop).isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(without(F.col(parts), F.col(drop)), "\n"))
    out = rows.withColumn("text", text).withColumn(removed, F.coalesce(F.size(drop), F.lit(0)).cast("long"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed and the text that is left, of every document."""
    return dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_removed", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL: dict[str, str] = {}
