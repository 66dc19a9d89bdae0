import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import phrases


def plain(rows):
    """The contract by a dictionary of all windows; a row's own words, in the order of the rows."""
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for s in range(len(w) - 12):
                k = tuple(w[s : s + 13])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        if doc is not None:
            for s in range(len(w) - 12):
                if first[tuple(w[s : s + 13])] < doc:
                    gone.update(range(s, s + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    return out


def dedup(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 1, True) for r in rows], "doc_id long, text string, th long, t string, id int, own boolean").repartition(4)
    return [tuple(r) for r in phrases.dedup_passages(docs).collect()]


def some_rows(seed, n=60, vocabulary=400, copies=0.6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(vocab, k=rng.choice([12, 13, 14, 20, 60])) for _ in range(12)]
    rows = []
    for d in rng.sample(range(10**6), n):
        words = []
        for _ in range(rng.randint(1, 5)):
            part = list(rng.choice(passages)) if rng.random() < copies else rng.choices(vocab, k=rng.randint(1, 30))
            lo = rng.randint(0, 4)
            part = part[lo : len(part) - rng.randint(0, 4)]
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = rng.choice(vocab)
            words += part
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = some_rows(seed)
    want = plain(rows)
    assert sum(r[2] for r in want) > 500
    assert sorted(dedup(spark, rows), key=repr) == sorted(want, key=repr)


def test_small_shards_parts_and_homes_give_the_same(spark, monkeypatch):
    rows = some_rows(3, n=40)
    for name, value in (("SHARD_PHRASES", 7), ("PART_ANCHORS", 5), ("HOME_PLACES", 16)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(dedup(spark, rows), key=repr) == sorted(plain(rows), key=repr)


def test_equal_anchor_hashes_change_nothing(spark, monkeypatch):
    """All phrases hash alike, so every home is wrong but for one document's."""
    rows = some_rows(4, n=25)
    monkeypatch.setattr(phrases, "_MUL", phrases.np.uint64(0))
    assert sorted(dedup(spark, rows), key=repr) == sorted(plain(rows), key=repr)


def test_nulls_repeats_long_texts_and_shared_ids(spark):
    thirteen = " ".join(f"t{i}" for i in range(13))
    long = " ".join(f"l{i % 977}" for i in range(40_000))
    rows = [(1, thirteen), (2, thirteen), (2, thirteen), (2, "other " + thirteen + " tail"), (None, thirteen), (None, None), (3, None), (4, ""), (5, "short text"), (6, "a " * 5000), (7, "a " * 13), (8, "a " * 12), (9, long), (10, long), (0, "b " + thirteen)]
    rows += [(11, "Ünï çödé " + thirteen + " \x00 \x1c    x"), (12, " ".join(thirteen.split()[:12]))]
    assert sorted(dedup(spark, rows), key=repr) == sorted(plain(rows), key=repr)


def test_empty_table(spark):
    assert dedup(spark, []) == []


def test_every_window_holds_an_anchor():
    rng = random.Random(6)
    for _ in range(30):
        words = [str(rng.randrange(6)).encode() for _ in range(rng.randint(0, 80))]
        at, h = phrases.anchors(words, phrases._Hashes())
        assert all(((at >= s) & (at <= s + 6)).any() for s in range(len(words) - 12))
        assert len(at) == len(h) == len(set(at.tolist()))
        g, first, again = phrases.once(at, h)
        assert sorted([p for p in first.tolist()] + [p for x in again if x for p in x]) == at.tolist() and len(set(g.tolist())) == len(g)
        assert all(h[at.tolist().index(p)] == g[k] for k in range(len(g)) for p in [first[k], *(again[k] or [])])
    at, _ = phrases.anchors([b"a"] * 7000, phrases._Hashes())
    assert len(at) <= 1001 and np.diff(at).max() <= 7
