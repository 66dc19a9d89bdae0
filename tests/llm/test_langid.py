import math
import time

import numpy as np

from tessera.llm import langid as L


def test_agrees_with_declared_and_path(spark):
    base = "/root/testdata/sf0.01"
    pages, docs = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("pages", "documents"))
    got = L.identify(pages, docs).join(pages, "page_id").collect()
    assert len(got) == pages.count()
    truth = [(r, r.url.split("/")[3]) for r in got if r.url.count("/") > 3 and r.url.split("/")[3] in ("en", "de", "fr", "es")]
    assert np.mean([r.lang == t for r, t in truth]) > 0.95
    assert all(0 < r.posterior <= 1.000001 for r in got)


def test_priors_match_plain_sums(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    rows = [(i, f"http://{h}/x", f"<html lang='{d}'><body>{t}</body></html>") for i, (h, d, t) in enumerate([("a.x.com", "en", "the dog and the cat"), ("a.x.com", "de", ""), ("b.x.com", "de", "die katze"), ("c.y.org", "", "und der hund")])]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    langs, table = L.fit_text(docs)
    texts = ["the dog and the cat", "", "die katze", "und der hund"]
    lls = []
    for t in texts:
        g = L._trigrams(t) if t else []
        lls.append(table.astype(np.float32)[:, g].mean(axis=1) * min(len(g), L.EVIDENCE) if len(g) else np.zeros(2))
    w = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in lls]
    mix = lambda c, p: (c + L.SMOOTH * p) / (c.sum() + L.SMOOTH)
    hosts, ends, said = ["a.x.com", "a.x.com", "b.x.com", "c.y.org"], ["com", "com", "com", "org"], ["en", "de", "de", ""]
    zero = np.zeros(2)
    for i in range(4):  # every count is of the other pages
        rest = [k for k in range(4) if k != i]
        of = lambda names: sum((w[k] for k in rest if names[k] == names[i]), zero)  # noqa: B023, E731
        suffix = mix(of(ends), mix(sum((w[k] for k in rest), zero), np.full(2, 0.5)))
        host = mix(of(hosts), mix(of(["x", "x", "x", "y"]), suffix))
        e = lls[i] + np.log(host) + np.log((of(said) + 0.5) / (sum((w[k] for k in rest), zero) + 0.5 * 4))
        assert got[i].lang == langs[int(e.argmax())]
        assert math.isclose(got[i].posterior, 1 / np.exp(e - e.max()).sum(), rel_tol=1e-4)
        assert math.isclose(got[i].e_suffix, np.log(suffix)[e.argmax()], rel_tol=1e-6)


def test_address(spark):
    urls = ["http://www.a.co.uk/x", "https://10.0.0.7:80/", "http://b.example.de", "http://localhost/", "nonsense", None]
    rows = L.address(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r.domain, r.suffix) for r in rows] == [("a.co.uk", "co.uk"), ("10.0.0.7", ""), ("example.de", "de"), ("localhost", "localhost"), ("", ""), ("", "")]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "die katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "no host", "", 2), (2, "HTTP://u@A.B.co:80/", "<p>die " * 20000, 3), (3, "http://localhost/", "<html LANG=DE>&amp;", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = L.identify(pages, docs).collect()
    assert len(got) == 5 and {r.host for r in got} == {"", "a.b.co", "localhost"}
    assert next(r for r in got if r.page_id == 2).lang == "de"
    assert L.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in L.identify(pages, docs.limit(0)).collect()} == {None}


def test_hostile_pages_take_no_time():
    began = time.time()
    for page in ("<" * 1_000_000, "<script " * 120_000, "<!-- " * 200_000, "<a " * 300_000 + ">", "</script" + " " * 900_000, "<SCRIPT>x</script >" * 50_000, "x" * 1_000_000 + "<"):
        L.visible(page)
    assert time.time() - began < 10


def test_hostile_declarations(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "die katze", "de")], "doc_id long, text string, lang string")
    rows = [(k, "http://a.b/", page) for k, page in enumerate(("<html " * 150_000, "<html" + " lan" * 250_000, "<" * 1_000_000))]
    began = time.time()
    assert L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).count() == 3
    assert time.time() - began < 60


def test_visible_text():
    page = "<html><HEAD>no</head ><body>a<script>var x = '<b>';</SCRIPT>b<!-- c <p> -->d&lt;e&amp;lt; <p\nclass=x>f</p>\t g<nav>menu"
    assert L.visible(page) == "a b d<e&lt; f g menu"
    assert L.visible("x <script>never ends <b>y</b>") == "x never ends y" and L.visible(None) == "" and L.visible("1 < 2 and <b") == "1 < 2 and <b"
