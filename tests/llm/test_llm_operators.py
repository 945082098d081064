"""The ten operators on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, jaccard_join, langid, line_dedup, mixing, packing, quality_model, quality_rules, substring_dedup, topk, warc_audit
from larkspur.llm.textstats import text_stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, rank int, component string"


def words(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (30, 80, 200, 60, 120, 7, 3)]
    out = [None, "", " \t\n", "one", *base, base[2], base[2], base[2].upper()]
    for k in range(8):  # near copies, some over the threshold and some under
        w = base[2].split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    passage = words(rng, 55)
    out += [words(rng, 40) + " " + passage + "\n" + words(rng, 30) for _ in range(3)]
    out += [words(rng, 9000), "\n".join([base[1], base[0], base[1], "Common line of text here", base[1] + " tail"]), "Common line of text here\nsomething else"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 1, "x", 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, texts[6], None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_find_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [common.NARROW_BYTES, 400])
def test_small_graphs_go_on_in_few_partitions(spark, monkeypatch, held):
    monkeypatch.setattr(common, "NARROW_BYTES", held)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(100, 90), (90, 95), (7, 7)], "a long, b long").repartition(30)
    with common.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "17"}):
        found = common.components(edges)
        got, parts = {r.node: r.component for r in found.collect()}, found.rdd.getNumPartitions()
    assert got == {**{i: (i - 1) // 20 * 20 + 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90}
    assert parts == 1 if held > 400 else parts > 1


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == docs.count() and line_dedup.dedup_lines(none).count() == 0
    rows = {r.doc_id: r for r in out.collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert rows[0].text is None and rows[1].text == "" and rows[2].text == whole[2]
    last = max(i for i in rows if i is not None)
    assert rows[last].text == "something else" and rows[last].n_chars == len("something else")
    assert rows[last - 1].text.split("\n") == ["Common line of text here"]  # its other lines stand in documents before it
    assert "python" not in out._jdf.queryExecution().toString().lower()


def test_line_dedup_compares_whole_lines(spark):
    rng = random.Random(8)
    line = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    runs = lambda t: {t[k : k + line_dedup.SHINGLE] for k in range(max(1, len(t) - line_dedup.SHINGLE + 1))}
    letters, han = "abcdefgh     ", "".join(map(chr, range(0x4E00, 0x4E40))) + "\U00020000"
    lines = ["https://www.example.com/a", "https://www.example.com/b", "一二三四五六七八九十一二三四五六七天", "一二三四五六七八九十一二三四五六七地人", "a" * 12, "a" * 30, "ab", "ac"]
    for n, kind in ((25, letters), (52, letters), (58, letters), (61, letters), (70, letters), (114, letters), (300, letters), (90, han), (5000, letters)):
        for _ in range(6):
            base = line(n, kind).strip()
            at = rng.randrange(len(base))
            lines += [base, base[:at] + "Z" + base[at + 1 :], base[: len(base) // 2] + line(len(base) // 4, kind) + base[len(base) // 2 :], base[:16] + line(n, kind)]
    norm = [x.strip().lower() for x in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(norm):
        for j in range(i):
            x, y = runs(norm[j]), runs(a)
            if 5 * len(x & y) >= 4 * len(x | y):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    want = {i: lines[i] if root[i] == i else "" for i in range(len(lines))}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == want
    assert 20 < sum(x == "" for x in want.values()) < 80


def test_line_dedup_tells_no_doc_id_from_zero(spark):
    text = "a line that stands twice\na line of its own\na line that stands twice"
    out = line_dedup.dedup_lines(spark.createDataFrame([(0, text), (None, text)], "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(0, ""), (None, "a line that stands twice\na line of its own")]


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def test_jaccard_join(docs, none):
    got = Counter(tuple(r) for r in jaccard_join.join(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()]) and jaccard_join.join(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_blocks_keep_every_link(docs, monkeypatch):
    for name, value in (("LONG", 2), ("BLOCK", 2), ("STAR_ROUNDS", 1), ("SHARE", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = Counter(tuple(r) for r in jaccard_join.join(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_small_sets_share_a_subset_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in range(jaccard_join.ALONE, jaccard_join.SMALL + 1):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for m in range(n, n + 8):
            inter = -(-jaccard_join.LINK * (n + m) // (100 + jaccard_join.LINK))
            if inter <= n and 100 * inter >= 85 * (n + m - inter):
                b = np.concatenate([rng.permutation(a)[:inter], rng.integers(0, 1 << 63, m - inter).astype(np.uint64)])
                assert np.intersect1d(jaccard_join.index_keys(np.unique(a)), jaccard_join.index_keys(np.unique(b))).size


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs, with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0])] += 1
    assert sum(r.length for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    by_doc = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
        by_doc[r.doc_id].append(r)
    for (doc, ids), n in want.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert Counter(p.piece for p in parts)[0] == sum(m for (d, _), m in want.items() if d == doc)
        if n == 1:
            assert [x for p in parts for x in p.ids] == list(ids) and all(p.length == 2048 for p in parts[1:])
    for seq in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none).count() == 0
    assert packing.token_ids("a<|endoftext|>b") == t.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_plans_fill_gaps_exactly():
    plans = packing.plan({10: 2, 6: 2, 4: 5, 3: 3, 2: 2, 1: 1}, 10)
    used = Counter()
    for parts, times in plans:
        assert sum(parts) <= 10
        for p in parts:
            used[p] += times
    assert used == Counter({10: 2, 6: 2, 4: 5, 3: 3, 2: 2, 1: 1}) and sum(t for _, t in plans) == 7


def brute_removed(rows):
    owner = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            owner[key] = min(owner.get(key, i), i) if i is not None else owner.get(key, 1 << 60)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and owner[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return out


def test_substring_dedup(docs, none):
    out = substring_dedup.dedup_substrings(docs)
    assert Counter(tuple(r) for r in out.drop("changed_text").collect()) == brute_removed([(r.doc_id, r.text) for r in docs.collect()])
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_mixing_meets_entropy_and_budget(spark, docs, none):
    tokens = {"a": 9000, "b": 900, "c": 100}
    e, w = mixing.solve(tokens, 10000, 0.9 * np.log(3))
    assert 0 < e < 1 and abs(mixing.entropy(w) - 0.9 * np.log(3)) < 1e-9
    _, w = mixing.solve(tokens, 10000, 0.9 * np.log(3), 3.0)
    assert max(w[s] * 10000 / tokens[s] for s in tokens) <= 3 + 1e-9
    assert mixing.solve({}, 1.0) == (1.0, {}) and mixing.solve({"a": 5}, 5, 0.0)[1] == {"a": 1.0}
    big = spark.createDataFrame([(i, "w " * (i % 40 + 1), "s" if i % 10 else "t") for i in range(4000)], "doc_id long, text string, source string")
    mixed = mixing.mix(big, block_tokens=500)
    got = {r.source: r for r in mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.first("source_weight").alias("w"), F.sum("n_tokens").alias("all")).collect()}
    total = sum(r["all"] for r in got.values())
    assert all(0 <= r.w * total - r.n <= 41 for r in got.values())
    kept = mixing.repeated(docs, keep_all=True, max_repeats=2.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mix(docs).columns[: len(docs.columns)] == docs.columns and mixing.mix(none).count() == 0


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(300)] + [(i, [0.5] * 20) for i in range(300, 340)]
    rows += [(400, None), (401, [None] * 20), (402, [float("nan")] * 20), (403, [1.0]), (404, []), (500, [3e18] * 20), (501, [2e18] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 50 = 0"), block=3).collect()}
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (i for i in ints if i % 50 == 0):
        hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        best = sorted((-hold(sum(x * y for x, y in zip(ints[q], v))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        assert [got[q, k + 1] for k in range(len(best))] == [(i, -s) for s, i in best]
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df, df.limit(0)).count() == 0


def test_topk_of_repeated_rows_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [rows[7]] * 9 + [rows[50]] * 3 + [(50, None), (50, rows[3][1]), (100, None), (9, rows[8][1])]
    large = [(i, [float(x) for x in 2.0 ** rng.integers(17, 20, 8)]) for i in (200, 201, 202, 250)]  # beyond 2^52 by the bound, exact in doubles
    for k, part in enumerate((rows, rows + large + large[:2] + large[3:])):
        df = spark.createDataFrame(part, "vec_id long, embedding array<float>").repartition(3)
        df.write.parquet(f"{tmp_path}/{k}.parquet")
        df = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
            want = Counter(con.execute(topk.SQL["op6_exact_topk"]).fetchall())
        assert Counter(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), block=3).collect()) == want


DATA = "/root/testdata/sf0.01"


def test_quality_model_on_held_out(spark, docs, none):
    out = quality_model.op7_quality_gam(spark, DATA).join(common.load(spark, DATA, "labels"), "doc_id").where("held_out").toPandas()
    assert ((out.predicted == out.quality).mean()) > 0.95
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(none, quality_model.train(none, labels)).count() == 0


def test_language_id_on_held_out(spark, docs, none):
    out = langid.op8_language_id(spark, DATA).join(common.load(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.95
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and all(r.lang_pred in ("und", "en", "de") and 0 <= r.score <= 1 for r in got.values())
    assert langid.train(none) is None and {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_quality_rules(spark, docs, none):
    rng = random.Random(2)
    clean = [(i, words(rng, 120), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in words(rng, 120).split()), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(20)) and got[1000].n_symbols == 360
    small = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert small[0].n_words == 0 and small[0].base_failed and not small[0].kept
    t = spark.createDataFrame([(1, "a b c a b c d\nx#\n\nx#\ny", None, None)], "doc_id long, text string, lang string, source string")
    r = quality_rules.judge(t).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (10, 12, 2, 1, 6)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(docs).columns == docs.columns
    assert abs(quality_rules.chi2_quantile(0.95, 6) - 12.5916) < 1e-3


def plain_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(found, found[1:], found[2:], strict=False))
    again = {i + j for i in range(len(found) - 2) if grams[tuple(found[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_base_counts_equal_plain_python(spark, texts):
    odd = ["a b a b a b", "é\u00a0ü\u3000x \x0b\x0c y\n\n \n", "日本 語 日本 語 日本 語 😀", "#\n#\n #\n<|>", "x x x", "x x"]
    stored = [r.text or "" for r in common.load(spark, DATA, "documents").select("text").collect()]
    every = [t or "" for t in texts] + odd + stored
    got, _ = text_stats([t.encode() for t in every], common.WordCodes())
    assert [tuple(r) for r in got.tolist()] == [plain_counts(t) for t in every]


def test_quality_rules_of_small_groups(spark):
    """A group of a few rows is judged by its own and its language's estimate; one of its own is never a bar."""
    rng = random.Random(8)
    clean = [(i, words(rng, 120), "en", f"s{i % 40}") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "***" for w in words(rng, 120).split()), "en", f"s{i}") for i in range(5)]
    lone = [(2000, words(rng, 120), "xx", "only"), (2001, words(rng, 120), None, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(clean + junk + lone, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(5)) and got[2000] and got[2001]


def test_fixity_audit_locates_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i % 700, f"http://h/{i}", "x" * (i % 97)) for i in range(900)] + [(None, None, None), (3, "http://h/3", "x" * 3), (9, "http://é/", "WARC/1.1\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").withColumn("offset", F.lit(1))
    held = warc_audit.records(pages, 100)
    assert held.count() == 902 and held.agg(F.sum("copies")).first()[0] == 903
    whole = warc_audit.spelled(pages)
    place = ["file", "offset", "length", "digest"]
    for name, records, kind in (("a", whole, "none"), ("b", warc_audit.damaged(whole), "gzip")):
        warc_audit.write_replica(records, str(tmp_path / name), warc_audit.files(held, 100), kind)
    ours, theirs = (warc_audit.read_replica(spark, str(tmp_path / x)) for x in "ab")
    want = {tuple(r) for r in held.select(*place).collect()}
    assert {tuple(r) for r in ours.select(*place).collect()} == want
    status = lambda p: "missing" if p is not None and p % 103 == 5 else "corrupt" if p is not None and p % 101 == 7 else "ok"
    expect = {(r.file, r.offset): status(r.page_id) for r in held.collect()}
    assert {(r.file, r.offset): r.status for r in warc_audit.audit(ours, theirs).collect()} == expect
    assert {r.status for r in warc_audit.audit(held, held).collect()} == {"ok"} and {r.status for r in warc_audit.audit(held.limit(0), held).collect()} == {"extra"}
    assert warc_audit.audit(held.limit(0), held.limit(0)).count() == 0

    spot = held.where("page_id = 50").orderBy("offset").first()  # one byte of a written file turns over
    (path,) = (tmp_path / "a" / f"file={spot.file}").glob("part-*")
    content = bytearray(path.read_bytes())
    content[spot.offset + spot.length - 6] ^= 1
    path.write_bytes(content)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    hit = warc_audit.audit(ours, warc_audit.read_replica(spark, str(tmp_path / "a"))).where("status <> 'ok'").collect()
    assert [(r.file, r.offset, r.status) for r in hit] == [(spot.file, spot.offset, "corrupt")]


def test_fixity_audit_goes_down_the_trees(spark, monkeypatch):
    rows = [(i % 3, 5000 * (i // 3), 5000, f"{i:064x}") for i in range(300)]
    held = spark.createDataFrame(rows, "file long, offset long, length long, digest string")
    other = spark.createDataFrame([(f, o, n, "bad" if (f, o) == (1, 250000) else d) for f, o, n, d in rows], held.schema)
    assert [(r.file, r.offset) for r in warc_audit.audit(held, other).where("status = 'corrupt'").collect()] == [(1, 250000)]
    monkeypatch.setattr(warc_audit, "gathered", lambda rows, *keys: rows.groupBy(*keys).agg(F.lit("same").alias("hash")))  # trees that tell nothing
    assert {r.status for r in warc_audit.audit(held, other).collect()} == {"ok"}


def test_substring_dedup_of_repeated_rows_and_ids(spark):
    rng = random.Random(11)
    passage, other = words(rng, 70), words(rng, 90)
    rows = [(1, passage), (2, words(rng, 20) + " " + passage), (2, words(rng, 20)), (3, passage + " " + other), (3, passage + " " + other), (3, "short"), (4, other), (0, words(rng, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.dedup_substrings(docs).drop("changed_text").collect())
    assert got == brute_removed(rows) and sum(got.values()) == len(rows)


def test_substring_dedup_needs_its_automata(spark, monkeypatch):
    rng = random.Random(12)
    passage = words(rng, 70)
    text = pa.array([words(rng, 9) + " " + passage])
    codes = common.word_codes(passage.encode().split(), common.WordCodes())
    phrases = [substring_dedup.spelled(codes[k : k + substring_dedup.PHRASE]) for k in range(len(codes) - substring_dedup.PHRASE + 1)]
    located = lambda found: [w for b in substring_dedup.locate([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), text, pa.array([found], pa.list_(pa.string()))], list("abcd"))]) for w in b.column(4).to_pylist()]
    assert set(range(9, 30)) <= set(located(phrases)) and located([]) == [] and located(["no such phrase"]) == []


def test_jaccard_join_of_ids_with_several_texts(spark):
    rng = random.Random(13)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(3, a), (9, a), (8, b), (9, b), (20, c), (20, ""), (20, c), (31, c), (40, "")]
    got = Counter(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(3, 37, 3), (9, 37, 3), (8, 37, 3), (9, 37, 3), (20, 37, 20), (20, 0, 20), (20, 37, 20), (31, 37, 20), (40, 0, 40)])


def test_jaccard_join_finds_links_of_large_sets(spark):
    rng = random.Random(14)
    rows = []
    for k in range(12):  # families of edited copies around the threshold, all large
        base = words(rng, 150 + 60 * k, f"f{k % 4}").split()
        for j in range(9):
            w = list(base)
            for _ in range(len(base) * j // 200):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    got = Counter(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_jaccard_boundary_is_the_cheapest():
    rule = jaccard_join.Rule()
    for sizes in ({20: 5, 60: 10, 300: 4}, {40: 100}, {150: 7, 20: 1}):
        cost = lambda x: sum(c * ((rule.subsets(n) if n <= x else 0) + (rule.bands if 100 * n >= rule.link * x else 0)) for n, c in sizes.items())
        assert cost(rule.cheapest(sizes)) == min(map(cost, range(rule.alone, jaccard_join.MOST_SMALL + 1)))


def test_line_dedup_of_large_buckets(spark, monkeypatch):
    for name, value in (("LARGE", 2), ("BLOCK", 2), ("STAR_ROUNDS", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(21)
    base, lines = words(rng, 30), []
    for k in range(40):  # many lines around one, some similar to others only
        w = base.split()
        for _ in range(k % 8):
            w[rng.randrange(len(w))] = words(rng, 1, "q")
        lines.append(" ".join(w))
    runs = lambda t: {t[k : k + line_dedup.SHINGLE] for k in range(max(1, len(t) - line_dedup.SHINGLE + 1))}
    root = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            x, y = runs(lines[j]), runs(a)
            if 5 * len(x & y) >= 4 * len(x | y):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert out == {i: lines[i] if root[i] == i else "" for i in range(len(lines))}
    assert 3 < len(set(root)) < 38


def test_rare_pairs_lose_no_link_and_pass_over_common_parts(spark):
    rng = random.Random(33)
    common_part, sets = rng.sample(range(1000), 70), []
    for k in range(60):
        sets.append(common_part + rng.sample(range(1000 + 100 * k, 1100 + 100 * k), 30))  # alike by less than 0.8, so far from any other
    for k in range(12):
        base = rng.sample(range(10_000 + 200 * k, 10_100 + 200 * k), 40 + k)
        sets += [base[j:] + rng.sample(range(20_000, 20_030), j) for j in range(6)]
    sets.append([])
    rows = [(i, i % 50, s) for i, s in enumerate(sets)]
    got = [tuple(r) for r in common.rare_pairs(spark.createDataFrame(rows, "node long, c long, s array<long>"), 4, 5).collect()]
    alike = {(i, j) for i, c, s in rows for j, d, t in rows if c < d and 5 * len({*s} & {*t}) >= 4 * len({*s} | {*t}) > 0}
    assert alike <= {*got} and len(got) == len({*got}) and 10 < len(alike)
    assert not [x for x in got if min(x) < 60]


def test_jaccard_long_lists_make_few_pairs_of_a_common_passage(spark, monkeypatch):
    for name, value in (("LONG", 2), ("BLOCK", 2), ("STAR_ROUNDS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    counts, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *more: (counts.append(pairs.count()), verified(pairs, *more))[1])
    rng = random.Random(35)
    passage = words(rng, 150)
    texts = [passage + " " + words(rng, 50, f"t{k}") for k in range(40)]  # a common passage of three quarters links none of them
    texts += [texts[7] + " a tail", texts[3] + " a tail"]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = spark.createDataFrame([(1, i, 197) for i in range(len(texts))], "k long, node long, n long")
    none = spark.createDataFrame([], "a long, b long")
    got = {r[0]: r[1] for r in jaccard_join.linked_classes(members, rows, jaccard_join.OWN, none).collect()}
    assert got == {7: 7, 40: 7, 3: 3, 41: 3}
    assert len(counts) == 2 and counts[0] == len(texts) - 1 and 2 <= counts[1] < len(texts)  # with the head, then by rare shingles


def test_line_dedup_verifies_in_compiled_code_and_cuts_each_line_once(spark):
    """Links are those of plain sets of code points; the sets come from UTF-32 bytes, no regular expression runs at every character."""
    whole = "the quick brown fox jumps over the lazy dog while nine grey geese fly south along the river"
    lines = [whole, whole + "s", whole.replace("geese", "ducks"), "漢字かな交じり文で書かれた長い一行の本文です", "漢字かな交じり文で書かれた長い一行の本文です。"]
    lines += ["a😀b😀c😀d😀e😀f😀g😀h😀i", "a😀b😀c😀d😀e😀f😀g😀h😀i😀", "straße über möchten", "short", "shorter", "ninechars", "abc" * 20, "abc" * 30]
    cut = lambda t: {t[k : k + line_dedup.SHINGLE] for k in range(max(1, len(t) - line_dedup.SHINGLE + 1))}
    rows = [(i, j, x, y) for i, x in enumerate(lines) for j, y in enumerate(lines) if i < j]
    want = {(i, j) for i, j, x, y in rows if 5 * len(cut(x) & cut(y)) >= 4 * len(cut(x) | cut(y))}
    found = line_dedup.linked(spark.createDataFrame(rows, "a long, b long, na string, nb string"))
    assert {(r.a, r.b) for r in found.collect()} == want and {(0, 1), (3, 4), (5, 6), (11, 12)} <= want and (0, 2) not in want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and re.search(r"\*\(\d+\) Filter .*array_intersect", plan) and len(re.findall(r"UTF-32", plan)) == 2


def test_line_dedup_sieves_many_keys_by_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_WORDS", 16)
    keys, rows = spark.range(0, 40_000, 10), spark.range(40_000)
    passed = lambda words: {r.id for r in common.sieve(rows, "id", keys, words).collect()}
    wide = passed(common.sieve_words(keys))
    assert wide >= set(range(0, 40_000, 10)) and len(wide) < 4000 + 36_000 // 8 < 0.9 * len(passed(None))
    monkeypatch.setattr(common, "SIEVE_MOST", 32)
    assert common.sieve_words(keys) == 32
    used, sieve = [], line_dedup.sieve
    monkeypatch.setattr(line_dedup, "sieve", lambda *a: used.append(a[3]) or sieve(*a))
    frame = spark.createDataFrame([(i, f"Line number {i} {i * i}\nThe same line in all of them") for i in range(600)], "doc_id long, text string")
    assert line_dedup.dedup_lines(frame).agg(F.sum("n_removed")).first()[0] >= 599 and len(used) == 3 and max(used) > 16
