import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_ends_in_sequences(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and (now == ids or name in ("quality_rules", "near_duplicates"))
        ids = now
    out = corpus_pipeline.run(spark, DATA)
    assert {r[0] for r in out.select("doc_id").collect()} == ids


def test_near_copies_go_at_five_words_and_four_fifths(spark):
    grams = lambda t, n: {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)}
    similar = lambda a, b, n: len(grams(a, n) & grams(b, n)) / len(grams(a, n) | grams(b, n))
    texts, want = [], set()
    for k, size in enumerate((44, 60, 90, 130, 300)):
        base = [f"w{k}x{i}" for i in range(size)]
        for extra in (0, (size - 4) // 4):  # 0.8 or a little more at five words, less than 0.85 at four
            texts.append(" ".join(base + [f"e{k}x{i}" for i in range(extra)]))
        assert 0.8 <= similar(*texts[-2:], 5) and similar(*texts[-2:], 4) < 0.85
        want.add(2 * k)
    texts.append(" ".join([f"w4x{i}" for i in range(300)] + [f"f{i}" for i in range(80)]))
    assert similar(texts[8], texts[-1], 5) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert {r.doc_id for r in kept.collect()} == want | {len(texts) - 1}
