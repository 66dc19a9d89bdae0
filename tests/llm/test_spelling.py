import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edited(a, b):
    """One inserted, deleted or replaced letter, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    form, near = {}, {}
    for w in n:
        own = [v for v in n if v != w and edited(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


def variants(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1, "k", 0) for r in rows], "doc_id long, text string, word string, n long, key string, block int").repartition(3)
    got = [tuple(r) for r in spelling.variants(docs, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["separate", "necessary", "straße-und-platz", "definitely", "Éclairages", "abcdefg", "bananas", "anabanas", "zzzzzzz"]
    letters = "abcdeéns"

    def typo(w):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind != 1) :]

    rows = []
    for d in range(60):
        words = []
        for w in base:
            words += [w] * rng.choice([1, 3, 40]) + [typo(w)] * rng.choice([0, 2]) + [typo(typo(w))] * rng.choice([0, 1])
        rng.shuffle(words)
        rows.append((d, " ".join(words)))
    rows += [(None, "separate nobodyknows nobodyknows"), (7, None), (8, ""), (9, "a" * 30000 + " " + "a" * 30000), (10, "a" * 30001), (11, "a" * 30001)] + [(70, "repeated repeated, REPEATED")] * 3
    rows += [(80 + k, f"chained{'x' * k} " * 11**k) for k in range(4)]  # forms of forms
    return rows


def test_equals_all_pairs(spark, rows):
    want = plain(rows)
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want)
    assert variants(spark, rows) == want


@pytest.mark.parametrize("shard_words", [1, 40])
def test_small_shards_and_blocks_give_the_same(spark, rows, shard_words):
    assert variants(spark, rows, shard_words=shard_words) == plain(rows)


def test_a_batch_of_words_that_ends_with_a_result_batch(spark, rows, monkeypatch):
    """Each word fills a result batch, so nothing is left when the batch of words ends."""
    monkeypatch.setattr(spelling, "CHUNK", 0)
    assert variants(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert variants(spark, []) == set()


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.text("abc", min_size=1, max_size=7))
def test_one_edit_equals_trying_all(a, b):
    a, b = sorted((a, b), key=len)
    if a != b and len(b) - len(a) <= 1:
        assert spelling.one_edit(a, b) == edited(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdé", min_size=7, max_size=9), min_size=2, max_size=12, unique=True), st.integers(1, spelling.GROUPS - 1))
def test_shards_and_search_reach_every_near_pair_once(words, level):
    met = Counter()
    shards = {}
    for w in words:
        shards.setdefault(spelling.vector(w)[:level], spelling.Trie()).add(spelling.vector(w)[level:], w, 1)
    for w in words:
        for shard, budget in spelling.reach(spelling.vector(w)[:level]):
            if shard in shards:
                met.update(tuple(sorted((w, v))) for v, _ in shards[shard].near(spelling._text(spelling.vector(w)[level:]), budget, w))
    assert met == Counter({tuple(sorted((a, b))): 1 for i, a in enumerate(words) for b in words[:i] if edited(a, b)})
