import random

import duckdb

from tessera.llm import decontaminate as D


def plain(docs, items):
    best = {}
    sets = [(i, D.words(t)) for i, t in items]
    for d, t, *_ in docs:
        tokens = D.words(t)
        for i, w in sets:
            k = min(5, len(w))
            s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
            shared = len(s & {tuple(tokens[j : j + k]) for j in range(len(tokens) - k + 1)}) if s else 0
            if s and d is not None and shared >= 0.8 * len(s):
                best[d, i] = max(best.get((d, i), (0, 0, 0)), (shared / len(s), shared, len(s)))
    return {(d, i, x[1], x[2]) for (d, i), x in best.items()}


def run(spark, docs, items, **kw):
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), **kw).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    return {tuple(r)[:4] for r in got}


def test_planted_in_long_texts(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 6, 9, 14, 30, 59, 200, 700])))) for i in range(60)]
    items += [(70, "too few words"), (71, ""), (72, None), (73, items[0][1]), (74, "w1 w2"), (75, "w7"), (0, items[9][1]), (0, "w3")]
    docs = []
    for d in range(300):
        body = text(rng.choice([0, 3, 50, 400, 3000]))
        for _ in range(rng.choice([0, 1, 2])):
            piece = rng.choice(items)[1]
            piece = (piece or "").upper().replace(" ", rng.choice([" ", ", ", "\n"])).split(" ")
            if rng.random() < 0.5 and len(piece) > 20:
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = piece
        docs.append((d, " ".join(body), "x"))
    docs += [(400, None, None), (401, "", ""), (None, items[3][1], ""), (402, items[4][1], ""), (402, items[4][1], ""), (402, items[5][1], ""), (403, "So: TOO few, words!", "")]
    want = plain(docs, items)
    assert len(want) > 150 and run(spark, docs, items) == want
    assert run(spark, docs, items, item_block=20) == want
    assert run(spark, docs, items, item_bytes=4000) == want


def test_table_and_sql(spark, sf):
    got = D.find(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(D.ORACLE).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and want


def test_empty(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    a, b = [(1, "one two three four five six")], [(2, "one two three four five six")]
    mk = spark.createDataFrame
    assert D.find(mk([], docs), mk(b, items)).count() == 0
    assert D.find(mk(a, docs), mk([], items)).count() == 0
    assert D.drop_contaminated(mk(a, docs), mk(b, items)).count() == 0
    assert D.drop_contaminated(mk(a, docs), mk([], items)).count() == 1
