"""Substring deduplication by repeated-phrase automata.

Every window of `WINDOW` words has one anchor, the `PHRASE`-word phrase with the smallest hash in it, so equal windows
have equal anchors. Anchors that several documents have are the recurring phrases: each is spelled once, from the
first document that has it, and confirmed against its hash. The phrases of a shard of documents are compiled into an
Aho-Corasick automaton, and the shard's documents are streamed through it, which locates every occurrence. Only
windows whose anchor the automaton located go on, to be confirmed by a 96-bit hash of their whole word sequence: one
that also starts in a document with a smaller doc_id covers words to remove. A document without any recurring phrase
cannot hold a recurring window, so no shard has it. Equal documents are one class and only the first is searched.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WordCodes, cut, load, mix, prepare, sieve, signed, texts_of, window_hashes, word_codes

WINDOW, PHRASE = 50, 10
_SPAN = WINDOW - PHRASE + 1


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each phrase, and for each window the place of its anchor (the first of equal ones)."""
    h = window_hashes(codes, PHRASE)
    if len(codes) < WINDOW:
        return h, np.empty(0, np.int64)
    places = []
    for at in range(0, len(codes) - WINDOW + 1, 1 << 14):
        part = h[at : at + (1 << 14) + _SPAN - 1]
        places.append(at + np.arange(len(part) - _SPAN + 1) + np.lib.stride_tricks.sliding_window_view(part, _SPAN).argmin(1))
    return h, np.concatenate(places)


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n_words, d1, d2 (digest of the words), sha (of all words joined), anchors (distinct) of every row."""

    def run(batches):
        cache = WordCodes()
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(2)):
                words = text.split()
                codes = word_codes(words, cache)
                h, at = anchors(codes)
                rows.append((len(words), *np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), "<i8").tolist(), hashlib.sha256(b" ".join(words)).hexdigest(), signed(np.unique(h[np.unique(at)]))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "t", "n_words", "d1", "d2", "sha", "anchors"])

    prepare(docs.sparkSession)
    return keyed_texts(docs).mapInArrow(run, "doc_id long, t long, n_words long, d1 long, d2 long, sha string, anchors array<long>")


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def spelled(codes: np.ndarray) -> str:
    """Two letters a word, the first from one alphabet and the second from another, so matches start at words."""
    letters = np.empty(2 * len(codes), "<u2")
    letters[0::2] = 0x100 + (codes & np.uint64(0x3FF))
    letters[1::2] = 0x800 + ((codes >> np.uint64(10)) & np.uint64(0x3FF))
    return letters.tobytes().decode("utf-16-le")


def spell(batches):
    """(text, hashes of phrases to spell) -> hash and spelling of each, whose words have been hashed anew."""
    cache = WordCodes()
    for batch in batches:
        found: dict[int, str] = {}
        for text, wanted in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            codes = word_codes(text.split(), cache)
            h, letters = signed(window_hashes(codes, PHRASE)), spelled(codes)
            for s in np.flatnonzero(np.isin(h, np.array(wanted, np.int64))):
                found.setdefault(int(h[s]), letters[2 * s : 2 * (s + PHRASE)])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["k", "phrase"])


def locate(batches):
    """(doc_id, t, text, phrases) -> hash and place of each window whose anchor the shard's automaton locates."""
    cache = WordCodes()
    for batch in batches:  # a shard
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in {x for own in batch.column(3).to_pylist() for x in own}:
            automaton.add_word(phrase)
        if not len(automaton):
            continue
        automaton.make_automaton()
        for doc, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            codes = word_codes(text.split(), cache)
            ends = np.fromiter((end for end, _ in automaton.iter(spelled(codes))), np.int64)
            hit = np.zeros(len(codes) + 1, bool)
            hit[(ends + 1) // 2 - PHRASE] = True
            places = np.flatnonzero(hit[anchors(codes)[1]])
            if len(places):
                h1 = window_hashes(codes, WINDOW)[places]
                h2 = window_hashes(mix(codes), WINDOW, 0xD6E8FEB86659FD93)[places]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array((signed(h2) >> 32).astype(np.int32)), pa.array([doc] * len(places), pa.int64()), pa.array([t] * len(places), pa.int64()), pa.array(places.astype(np.int32))], ["h1", "h2", "doc_id", "t", "place"])


def rub_out(batches):
    """(doc_id, t, text, places of windows to remove) -> what is left."""
    for batch in batches:
        rows = []
        for text, places in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            marks = np.zeros(len(words) + 1, np.int64)
            p = np.array(places)
            np.add.at(marks, p, 1)
            np.add.at(marks, p + WINDOW, -1)
            gone = np.cumsum(marks[:-1]) > 0
            left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
            rows.append((int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "t", "gone", "left_sha", "left"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, changed_text for every row of docs (doc_id, text).

    changed_text holds the kept words, joined by single spaces, of rows that lose words, and is null where the text
    stays as it is. Null and empty texts have no words. Texts of fewer words than a window lose none. Rows with equal
    doc_id do not count against each other, whether their texts are equal or not; each keeps its own row. A null
    doc_id is never removed from and removes nothing. Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = cut(survey(docs))
    classes = cut(rows.where("doc_id IS NOT NULL AND n_words >= 50").groupBy("d1", "d2").agg(F.min("doc_id").alias("first")))
    keyed = rows.join(classes, ["d1", "d2"]).where("doc_id = first").select(F.explode("anchors").alias("k"), F.col("doc_id").alias("node"), "t").distinct()
    several = cut(keyed.groupBy("k").agg(F.min("node").alias("pivot"), F.max("node").alias("top"), F.min_by("t", "node").alias("pivot_t")).where("pivot < top").drop("top"))
    texts = keyed_texts(docs)
    words = lambda keys: sieve(texts, "doc_id", keys.select("doc_id"))
    to_spell = cut(several.groupBy(F.col("pivot").alias("doc_id"), F.col("pivot_t").alias("t")).agg(F.collect_set("k").alias("ks")))
    spelled_once = words(to_spell).join(to_spell, ["doc_id", "t"]).select("text", "ks").mapInArrow(spell, "k long, phrase string")
    phrases = cut(spelled_once.groupBy("k").agg(F.min("phrase").alias("phrase")))
    wanted = keyed.join(phrases, "k").groupBy(F.col("node").alias("doc_id"), "t").agg(F.collect_set("phrase").alias("phrases"))
    wanted = cut(wanted)
    windows = cut(words(wanted).join(wanted, ["doc_id", "t"]).select("doc_id", "t", "text", "phrases").mapInArrow(locate, "h1 long, h2 int, doc_id long, t long, place int"))
    owners = cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"))
    places = cut(windows.join(owners, ["h1", "h2"]).where("doc_id > owner").groupBy("doc_id", "t").agg(F.collect_set("place").alias("places")))
    left = words(places).join(places, ["doc_id", "t"]).select("doc_id", "t", "text", "places").mapInArrow(rub_out, "doc_id long, t long, gone long, left_sha string, left string")
    left = left.groupBy("doc_id", "t").agg(F.first("gone").alias("gone"), F.first("left_sha").alias("left_sha"), F.first("left").alias("left"))  # repeated rows are equal
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    out = rows.drop("anchors").join(classes, ["d1", "d2"], "left").join(left, ["doc_id", "t"], "left")
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("left")).alias("changed_text"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(load(spark, sf_dir, "documents")).drop("changed_text")


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
SQL: dict[str, str] = {}
