import hashlib

import numpy as np

from tessera.llm import sketch as S


def plain(rows):
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        text = t[: len(t) - half] + after[:half]
        a, b, c = (S.sketch(x) for x in (t, text, after))
        out.append((i, len(t), hashlib.sha256(text.encode()).hexdigest(), S.to_text(a), S.to_text(b), S.likeness(a, b), S.likeness(a, c), min(len(a), len(b)), min(len(a), len(c))))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2])


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in S.fingerprints(docs).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    near = np.array([(r[5], r[6]) for r in got if r[1] > 400])
    assert np.quantile(near[:, 0], 0.05) > 0.3 and np.median(near[:, 1]) < 0.1


def test_edges(spark):
    rows = [(5, None, "a"), (5, "same text here", "a"), (5, "same text here", "b"), (None, "no id at all", "c"), (7, "", "d"), (9, "wörd " * 30000, "e"), (8, "x", "f")]
    got = [tuple(r) for r in S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, chunk string")).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    one = S.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert S.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_and_containment():
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(9000)]
    long, short = " ".join(words), " ".join(words[500:900])
    assert S.likeness(S.sketch(long), S.sketch(short)) > 0.95
    a, b = " ".join(words[:300]), " ".join(words[200:700])
    merged = S.from_text(S.merge(S.to_text(S.sketch(a)), S.to_text(S.sketch(b))))
    assert np.array_equal(merged, np.union1d(S.sketch(a), S.sketch(b)))


def test_short_texts_differ():
    texts = ["abc", "xyz", "hello", "Hello there", "", "a"]
    prints = {t: S.to_text(S.sketch(t)) for t in texts}
    assert len(set(prints.values())) == len(texts) and prints[""] == "" and any(p.startswith("~") for p in prints.values())
    assert all(np.array_equal(S.from_text(p), S.sketch(t)) for t, p in prints.items())
    assert all(S.likeness(S.sketch(a), S.sketch(b)) == (a == b) for a in texts for b in texts)
    long = S.to_text(S.sketch("a longer text " * 3 + "with many words in it, all of them kept or not"))
    assert S.merge(prints["abc"], long) == long and S.merge(prints["abc"], prints["abc"]) == prints["abc"]


def test_chunks_equal_a_count_of_bounds(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 100):
        bounds = sorted({int(x) for x in rng.integers(-50, 50, n)})
        keys = spark.createDataFrame([(k,) for k in range(-52, 53)], "key long")
        assert all(r.c == sum(b < r.key for b in bounds) for r in keys.select("key", S._chunk(bounds).alias("c")).collect())
