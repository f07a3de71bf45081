import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, d).toPandas())
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.select("doc_id").distinct().count() == docs.count() <= n
    assert sorted(docs.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]


def test_kept_ids_and_texts(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(60), say(20)
    texts = [base, base, base + " tail", "", "  ", say(3), say(40) + "\n" + passage, passage + " " + say(30), *(say(50) for _ in range(6)), None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    like = lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    gone = {j for j in range(len(texts)) for i in range(j) if like(i, j)}  # here every copy resembles its first
    assert gone == {1, 2}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.keep_first_near(spark, docs, "").collect()}
    assert got == {k: t for k, t in enumerate(texts) if k not in gone}

    seen, want = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        grams = [b[p : p + 50] for p in range(len(b) - 49)]
        cut = {q for p, g in enumerate(grams) if g in seen for q in range(p, p + 50)}
        seen.update(grams)
        want[k] = None if t is None else bytes(x for q, x in enumerate(b) if q not in cut).decode()
    assert want[1] == "" and len(want[7]) < len(texts[7])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == want

    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda s, d, name: {"benchmark": items, "labels": labels}[name])
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_leaks(spark, docs, "").collect()}
    assert kept == {k: t for k, t in enumerate(texts) if k not in (6, 7)}

    marked = spark.createDataFrame([(k, f"calm text {k} about things" if k % 2 else f"*** {k} $$$ now!!", "en", "s", 1) for k in range(200)], docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, marked, "").collect()} == set(range(1, 200, 2))


CASES = [(None, None), (None, ""), (1, None), (2, ""), (3, "calm text three about things"), (3, "calm text three about things"), (4, "calm text three about things"), (None, "calm text three about things"), (5, " \n"), (6, "word " * 30_000), (7, "\u00e9" * 70)]


def case_frame(spark):
    rows = [(k, t, None if n % 2 else "en", None, n, "clash", 7, 8) for n, (k, t) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, cls int, component_id int").repartition(3)


def test_stages_on_odd_rows(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, equal texts and columns with clashing names."""
    items = spark.createDataFrame([(1, "about things of three"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(None, 1), (3, None)], "doc_id long, quality int")
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda s, d, name: {"benchmark": items, "labels": labels}[name])
    texts = lambda df: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in df.collect()))
    key = lambda rows: sorted((k is None, k or 0, t is None, t or "") for k, t in rows)
    docs = case_frame(spark)
    kept = corpus_pipeline.keep_quality(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS and set(texts(kept)) <= set(key(CASES))
    near = corpus_pipeline.keep_first_near(spark, docs, "")
    assert near.columns == corpus_pipeline.COLUMNS and texts(near) == key([r for r in CASES if r[0] != 4])
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert cut.columns == corpus_pipeline.COLUMNS and texts(cut) == key(CASES)
    clean = corpus_pipeline.drop_leaks(spark, docs, "")
    assert clean.columns == corpus_pipeline.COLUMNS and texts(clean) == key(CASES)
    assert corpus_pipeline.tokens(spark, docs, "").count() == len(CASES)
    leak = corpus_pipeline.drop_leaks(spark, docs.withColumn("text", F.concat(F.col("text"), F.lit(" about things of three"))), "")
    assert texts(leak) == key([r for r in CASES if r[1] is None])  # null ids are judged by their text too
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
