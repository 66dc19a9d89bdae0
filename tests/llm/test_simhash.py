import random
import re

import xxhash

from tessera.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def check(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, v string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    comp = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_matches_plain_loop(spark):
    rng = random.Random(3)
    vocab = ["Alpha", "beta", "gamé", "delta", "EPS", "zeta", "eta", "İx"]
    rows, base = [], []
    for i in range(120):
        if base and rng.random() < 0.6:
            words = list(rng.choice(base))
            words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        base.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(words), "x", "y"))
    rows += [(900, None, None, None), (901, "", "a", None), (902, " \n", "a", None), (903, "word " * 20000, "a", "b")]
    check(spark, rows)


def test_table(spark, sf):
    rows = [(r.doc_id, r.text, "", "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_every_pair_in_radius_collides():
    rng = random.Random(1)
    tables = [m & (2**64 - 1) for m in simhash.masks()]
    for _ in range(3000):
        x, y = rng.getrandbits(64), 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y |= 1 << b
        assert any(x & m == (x ^ y) & m for m in tables)


def test_blocks_do_not_change_links(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(300)]
    rows = spark.createDataFrame([(v, v, 0) for v in set(values)], "node long, fp long, seg int")
    from tessera.llm.components import connected_components

    got = [sorted(tuple(r) for r in connected_components(simhash.links(rows, block=b)).collect()) for b in (7, 4096)]
    assert got[0] == got[1] and got[0]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, "q r s t")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [1, 1, 1, 1, 3]
    assert sorted((r.doc_id or 0) for r in simhash.keep_first(docs).collect()) == [0, 1, 3]


def test_components_of_chain_and_star(spark):
    from tessera.llm.components import connected_components

    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and 200 not in got


def test_many_texts_of_one_filler_give_few_candidates(spark):
    """Fingerprints of texts that repeat one filler are equal; their shingle sets are not."""
    rng = random.Random(1)
    texts = [(i, "filler words of the page " * 60 + " ".join(f"own{rng.randrange(10**6)}" for _ in range(40))) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    fps = simhash.fingerprints(docs, segments=2, whole=True).collect()
    assert len({r.fp0 for r in fps}) < 50  # they all collide
    rows = spark.createDataFrame([(r.id, r.sk, k, r[f"fp{k}"], r.id) for r in fps for k in range(2)], "node long, sk long, seg int, fp long, label long")
    assert simhash.links(rows, 3, 14, every=True).count() < 0.05 * 2 * 1999 * 1000
    kept = simhash.keep_first(docs.unionByName(spark.createDataFrame([(5000, texts[7][1] + " more")], "doc_id long, text string")))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(2000))


def test_sketches_of_similar_texts_are_near():
    rng = random.Random(2)
    far = 0
    for _ in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 30, 100, 500]))]
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[rng.randrange(len(other))] = "changed"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            assert (simhash.sketch(" ".join(words)) ^ simhash.sketch(" ".join(other))).bit_count() <= simhash.SKETCH_BITS
            far += 1
    assert far > 100
    assert simhash.sketch(None) == simhash.sketch("")


def test_every_pair_is_given_in_its_first_table(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)})
    rows = [(i, 0, 0, fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in enumerate(fps)]
    got = simhash.links(spark.createDataFrame(rows, "node long, sk long, seg int, fp long, label long"), 3, every=True)
    assert got.count() == got.distinct().count() == sum((a ^ b).bit_count() <= 3 for i, a in enumerate(fps) for b in fps[:i])


def test_tables_are_met_once(spark, monkeypatch):
    """All documents go through the covering tables in one pass, of which only what shares a bucket is held."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(300)]
    rows = list(enumerate([*texts, *(t + " more" for t in texts[:20])]))
    met, buckets = [], simhash.buckets
    monkeypatch.setattr(simhash, "buckets", lambda *a: met.append(buckets(*a)) or met[-1])
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(300))
    assert len(met) == 1 and met[0].columns == ["node", "fp", "v", "key"]
    held = {r.node for r in met[0].select("node").distinct().collect()}
    assert {*range(20), *range(300, 320)} <= held and len(held) < 100
    assert met[0]._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
