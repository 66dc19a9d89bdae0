import random
import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=3, top=200):
    """The contract by loops over every term of every group."""
    count, docs, langs = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        own = [w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        langs[lang].add(source)
        count.update((lang, source, w) for w in own)
        docs.update((lang, w) for w in set(own))
    out = set()
    for lang, sources in langs.items():
        kept = sorted((w for (x, w), n in docs.items() if x == lang and n >= least_docs), key=str.encode)

        def shares(n):
            total = sum(n) + len(kept)
            return [1 + 10**9 * (c + 1) // total for c in n]

        f = lambda p, q: (p - q) * (p - q) // q
        per = {s: [count[lang, s, w] for w in kept] for s in sources}
        own, base = {s: shares(n) for s, n in per.items()}, shares([sum(n) for n in zip(*per.values())])
        for s in sources:
            pairs = sorted(((-sum(map(f, own[s], own[o])), o.encode(), o) for o in sources - {s}))
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-f(p, q), w.encode(), w) for p, q, n, w in zip(own[s], base, per[s], kept) if n and p > q)[:top]
            out |= {(lang, s, "term", w, -v, r) for r, (v, _, w) in enumerate(terms, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string, term string, n long, shard int, a string, value int").repartition(3)


def audit(spark, rows, **how):
    got = divergence.audit(table(spark, [(*r, "x", 1, 1, "x", 1) for r in rows]), **how).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_equals_loops_over_all_terms(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "Ärger", "ärger", "été", "x1y", "日本", "de-lta", "a", "b", "c"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", "é", None]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("fr", "lonely", "one two"), ("it", "p", None), ("it", "q", ""), ("it", "r", "!!! 123")] + [("en", "s1", "Alpha beta")] * 5 + [("nl", "m", "huis " * 3000), ("nl", "n", "huis"), ("nl", "n", "huis boom")]
    want = plain(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("it", "p", "pair", "q", 0, 1) in want
    assert audit(spark, rows) == want
    assert audit(spark, rows, shard_terms=2) == want  # several shards a language
    assert audit(spark, rows, top=2) == plain(rows, top=2)
    assert audit(spark, rows, least_docs=10**6) == plain(rows, least_docs=10**6)


def test_empty_table(spark):
    assert audit(spark, []) == set()


def test_prices_are_exact_for_large_counts():
    n = np.array([0, 5, 10**13, 9 * 10**9 + 7], dtype=np.int64)
    total = int(n.sum()) + 4
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in n]


def test_gallop_and_price_equal_plain_merge():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        sides = [{int(i): int(rng.integers(1, 9)) for i in rng.choice(size, int(rng.integers(0, size + 1)), replace=False)} for _ in range(2)]
        arrays = [tuple(np.array(x, np.int64) for x in (sorted(s), [s[k] for k in sorted(s)])) for s in sides]
        totals = [sum(s.values()) + size for s in sides]
        p, q = ([1 + 10**9 * (s.get(i, 0) + 1) // t for i in range(size)] for s, t in zip(sides, totals))
        want = sum((x - y) ** 2 // y for x, y in zip(p, q)), sum((y - x) ** 2 // x for x, y in zip(p, q))
        assert divergence.price(arrays[0], arrays[1], size, *totals) == want
