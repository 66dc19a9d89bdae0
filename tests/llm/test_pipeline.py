import random

import corpus_pipeline
from tessera.llm import decontaminate, simhash


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("a", "en", "ing", "or", "us", "th", "ly", "ed")]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, near = [], set()
    for i in range(60):
        base = text(rng.choice([120, 300]))
        rows.append((10 * i, " ".join(base), "en"))
        if i % 3 == 0:
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 * i + 1, " ".join(copy), "en"))
            near.add(10 * i + 1)
    rows += [(2000, "", "x"), (2001, None, "x"), (None, "no id", "x"), (2002, "no id", "x"), (2002, "no id", "x")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert got.columns == ["doc_id", "text", "fp"]
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect())
    assert kept == sorted({r[0] if r[0] is not None else -1 for r in rows} - near - {2001})


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).cache()
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in docs.collect():
        own = decontaminate.shingles(decontaminate.words(r.text))
        for _, t in items:
            s = decontaminate.shingles(decontaminate.words(t))
            assert not s or len(s & own) < 0.8 * len(s)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} <= ids


def test_close_pairs_in_a_loose_family(spark, monkeypatch):
    """One bucket of A, B, C: A is loosely like both, B and C are near-copies; a forest from A alone would lose B-C."""
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(10**9))
    a = [word() for _ in range(200)]
    b = a[:170] + [word() for _ in range(30)]
    c = [*b[:-1], word()]
    rows = [(k, " ".join([*t, f"w{k}"])) for k, t in enumerate((a, b, c), 1)]
    sets = {k: grams(t) for k, t in rows}
    like = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert like(1, 2) < 0.8 and like(1, 3) < 0.8 and like(2, 3) >= 0.8

    def near_prints(docs, id_col, text_col, segments, **more):
        # equal but for the last fingerprint, so every bucket that holds B and C holds A too
        last = f"CASE id WHEN 1 THEN 0L WHEN 2 THEN 4294967295L ELSE -4294967296L END AS fp{segments - 1}"
        return docs.selectExpr("id", "id AS whole", "0L AS sk", *[f"0L AS fp{k}" for k in range(segments - 1)], last)

    monkeypatch.setattr(simhash, "fingerprints", near_prints)
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_filler_does_not_merge_documents(spark):
    """One shingle over half of a text sets every fingerprint; what else the text says still counts."""
    rng = random.Random(6)
    rows = [(k, " ".join(["x"] * 90 + [f"w{rng.randrange(10**9)}" for _ in range(40)])) for k in range(6)]
    rows.append((6, rows[0][1].upper().replace(" ", "\n")))
    assert len({tuple(simhash.fingerprint(t, segments=8)) for _, t in rows}) == 1
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


def test_rows_that_share_an_id_stay(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "one two three four five six"), (3, "q r s t u v"), (3, "q r s t u v")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[1], rows[2], rows[3]]


def test_recall_of_candidates():
    """Nine in ten pairs at a similarity of 0.8 collide in a table of one of the fingerprints."""
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bcdfghjklmnp" for b in ("a", "en", "ing", "or", "us", "th") for c in "xyzw"]
    tables = [m & (2**64 - 1) for m in simhash.masks()]
    found = tried = 0
    while tried < 150:
        a = [rng.choice(vocab) for _ in range(rng.choice([60, 120, 300, 800]))]
        b, like = a, 1.0
        while True:
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(vocab)
            x, y = grams(" ".join(a)), grams(" ".join(c))
            if len(x & y) < 0.8 * len(x | y):
                break
            b, like = c, len(x & y) / len(x | y)
        if like > 0.85:
            continue
        tried += 1
        prints = [simhash.fingerprint(" ".join(t), segments=simhash.SEGMENTS) for t in (a, b)]
        found += any((p ^ q).bit_count() <= simhash.ACCEPT and any((p ^ q) & m == 0 for m in tables) for p, q in zip(*prints))
    assert found >= 0.9 * tried


def test_stages_take_nulls_empties_and_columns_of_their_own_names(spark, sf):
    """Each stage keeps the columns, whatever their names, and what is clean; an empty table stays empty."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long = text(12_000)
    rows = [(1, None), (2, ""), (3, "   \n \n"), (None, text(30)), (None, None), (4, text(40)), (5, long), (6, text(1)), (7, "tab\tand\nline")]
    names = "id long, t string, th long, node long, y int, component long, sk long, whole string, key long, c long, item long, n int"
    extra = (1, "t", 2, 3, 1, 4, 5, "w", 6, 7, 8, 9)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            if name == "packing":
                assert out.count() == table.count()
                break
            got = out.collect()
            assert out.columns == docs.columns, name
            if table is docs:
                held = {r.doc_id for r in got}
                # texts without words are copies of one another
                assert held == ({None, 1, 4, 5, 6, 7} if name == "simhash_near_dedup" else {None, *range(1, 8)}), name
                assert {r.text for r in got if r.doc_id == 5} == {long}, name
            else:
                assert got == [], name
