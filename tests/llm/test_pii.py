import hashlib
import math
import random
import re

from tessera.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def check(rows, got):
    want = sorted((i if i is not None else -1, tuple(plain(t))) for i, t, *_ in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, tuple(x for x in r.spans.split(",") if x and not x.startswith("term"))) for r in got)
    assert have == want
    for r in got:
        base = [x for x in r.spans.split(",") if x and not x.startswith("term")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in PLAIN]


def test_base_matches_plain_patterns(spark):
    rng = random.Random(13)
    bits = ["a@b.c", "_d@e.f", "x.y%z@mail-1.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "00010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4716", " ", "-", "+1 (386) 555-3733", "+", "555", "é", "😀", "word ", "1.2.3.4.5.6.7.8", "12345678901", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "x") for i in range(500)]
    rows += [(900, None, "t"), (901, "", "t"), (901, "", "t"), (None, "q@r.s", "t"), (902, "9" * 50000 + " x@" + "a." * 20000 + "b", "t"), (903, "word " * 20000 + "1.2.3.4", None)]
    check(rows, pii.find(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pii.find(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(40)) for i in range(200)]
    rows += [(300 + i, f"{text(12)} Zaphod wrote from z@b.com {text(20)}") for i in range(6)]
    rows += [(400, f"{text(5)} and Zaphod! {text(3)}"), (500, "copied Trillian t@b.com once"), (501, "copied Trillian t@b.com once"), (502, "copied Trillian t@b.com once")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zaphod" not in got[400].sanitised and got[400].n_terms == 1
    a, b = re.search(r"term:(\d+):(\d+)", got[400].spans).groups()
    assert dict(rows)[400][int(a) : int(b)] == "Zaphod"
    assert got[500].n_terms == 0 and "[EMAIL]" in got[500].sanitised
    assert all(got[i].sanitised == t for i, t in rows[:200])


def plain_terms(rows):
    """Disclosure of every term by loops over documents."""
    docs = list({(i, t or "") for i, t in rows})
    word = lambda x: set(re.findall(r"[^\W\d_]\w{2,}", x.lower()))
    near, n_e, n_t = {}, {}, {}
    for doc in docs:
        i, t = doc
        for w in word(t):
            n_t[w] = n_t.get(w, 0) + 1
        for span in plain(t):
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            value = t[a:b].lower() if kind in ("email", "ip") else kind + re.sub("[^0-9]", "", t[a:b])
            around = (t[max(0, a - pii.CONTEXT) : a] + " \n " + t[b : b + pii.CONTEXT]).lower()
            n_e.setdefault(value, set()).add(doc)
            for w in word(around):
                near.setdefault((value, w), []).append((around, doc))
            near.setdefault((value, None), []).append((around, doc))
    found = {}
    for (e, w), places in near.items():
        few = lambda held: min(len({c for c, _ in held}), len({t for _, (_, t) in held})) < pii.SUPPORT
        if w is None or few(places) or few(near[e, None]):
            continue
        p_e, p_et = len(n_e[e]) / max(2, len(docs)), min(1, len({d for _, d in places}) / n_t.get(w, 1))
        share = math.log(p_et / p_e) / -math.log(p_e) if p_e < 1 else 0
        if share >= pii.GENERALISE:
            found[w] = max(found.get(w, 0), share)
    return found


def test_disclosure_matches_loops(spark):
    rng = random.Random(12)
    vocab, names = [f"word{i}" for i in range(80)], [f"name{i}" for i in range(8)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(150)]
    for i in range(200, 260):
        k = rng.randrange(8)
        rows.append((i, " ".join([*(rng.choice(vocab) for _ in range(rng.randint(1, 40))), names[k], f"box{k}@b.com", *(rng.choice(vocab) for _ in range(5)), rng.choice(names)])))
    rows += [(i + 1000, t) for i, t in rows[-20:]]
    docs = spark.createDataFrame(rows, "d long, t string")
    docs = docs.selectExpr("d", "xxhash64(t) AS th", "t").withColumn("base", pii.base_spans(docs["t"]))
    got = {r.term: round(r.disclosure, 9) for r in pii.disclosing_terms(docs).collect()}
    want = {w: round(x, 9) for w, x in plain_terms(rows).items()}
    assert got == want and got


def test_terms_are_found_and_only_these(spark):
    """Precision and recall of planted terms, among documents that name an entity often, and copies and edits of one."""
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(30)) for i in range(400)]
    for k in range(20):
        rows += [(1000 + 10 * k + j, f"{text(8)} planted{k} reach box{k}@mail.org {text(9)}") for j in range(5)]
    rows += [(2000, " ".join(f"{text(30)} alone solo@mail.org" for _ in range(6)))]
    rows += [(2100 + j, f"edited twin@mail.org {'very ' * j}much") for j in range(5)]
    rows += [(2200 + j, f"{text(20)} planted3 without its address") for j in range(1)]
    docs = spark.createDataFrame(rows, "d long, t string")
    docs = docs.selectExpr("d", "xxhash64(t) AS th", "t").withColumn("base", pii.base_spans(docs["t"]))
    found = {r.term: r.kind for r in pii.disclosing_terms(docs).collect()}
    planted = {f"planted{k}" for k in range(20)}
    assert planted <= set(found) and set(found.values()) == {0}
    wrong = {w for w in found if w not in planted and not w.startswith(("box", "edited", "twin", "much"))}
    assert len(wrong) <= 2 and "alone" not in found and "solo" not in found, wrong


def test_clean_documents_stay(spark):
    got = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.where("n_email + n_ip + n_card + n_phone = 0 AND n_terms > 0").count() == 0


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string, t string")).count() == 0
