"""Language of web pages by Bayesian evidence fusion.

log P(language | page) adds, up to a constant, the text's likelihood under character-trigram models, the likelihood
of the declared markup language, and a prior of the page's host. Text models are fitted on a bounded sample of
labelled documents. The other tables come from grouped aggregations over all pages, weighted by what the text alone
says. Host priors are smoothed towards their registered domain, that towards its address suffix, and that towards the
whole, so a host with few pages leans on its parents; the suffix is evidence there and nowhere else. A page's own
text is left out of every count that is held against it, so no evidence counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut

#: Labelled documents to a language that the text models read, about; chosen by a hash of their id.
FIT_ROWS = 2_000
#: Trigram hash buckets of a text model.
BUCKETS = 1 << 16
#: Weight of a parent's distribution in a child's, in pages.
SMOOTH = 5.0
#: Text counts as so many independent trigrams at most, as neighbours are not independent.
EVIDENCE = 60.0
#: Bytes up to which the counts by declared language are broadcast; what pages declare is theirs to choose.
BROADCAST_BYTES = 4 << 20
_MUL = np.uint32(2654435761)
_BLOCK = re.compile(r"<(?:(script|style|nav|head)\b|!--)", re.IGNORECASE)
_ENDS = {"": re.compile("-->"), **{name: re.compile(rf"</{name}[ \t\n\r\f\v]*>", re.IGNORECASE) for name in ("script", "style", "nav", "head")}}
_TAG = re.compile("<[^<>]*>")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def _trigrams(text: str) -> np.ndarray:
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint32(31) + codes[1:-1]) * np.uint32(31) + codes[2:]
    return ((h * _MUL) >> np.uint32(16)).astype(np.int64)


def fit_text(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by trigram bucket, from about ``fit_rows`` documents of each."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, int(min(1.0, fit_rows / n) * 1_000_000)).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lang, texts in part.groupby("lang")["t"]:
                tally = sum((np.bincount(_trigrams(t), minlength=BUCKETS) for t in texts), np.zeros(BUCKETS, np.int64))
                yield pd.DataFrame({"lang": lang, "bucket": np.flatnonzero(tally), "n": tally[tally > 0]})

    rows = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted(sizes)
    table = np.full((len(langs), BUCKETS), 0.5)
    for r in rows:
        table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def visible(html: str | None) -> str:
    """Visible text: scripts, styles, comments and tags out, common entities back, white space closed up.

    One way through the page: a block or comment that never ends is looked for once, and stays text but for its tags.
    """
    html, kept, at, seek, endless = html or "", [], 0, 0, set()
    while (found := _BLOCK.search(html, seek)) is not None:
        name = (found[1] or "").lower()
        end = None if name in endless else _ENDS[name].search(html, found.end())
        if end is None:
            endless.add(name)
            seek = found.end()
            continue
        kept.append(html[at : found.start()])
        at = seek = end.end()
    bare = _TAG.sub(" ", " ".join([*kept, html[at:]]))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = bare.replace(entity, char)
    return " ".join(_SPACE.split(bare)).strip(" ")


def address(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host, domain, suffix`` of an address; one without a host gives empty ones, a numeric host is its own domain."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    parts = F.split("host", r"\.")
    # a usual label before a country is part of the suffix, as in co.uk
    deep = F.col("host").rlike(r"\.[^.]+\.(com|org|net|gov|edu|ac|co|or|ne|go)\.[a-z]{2}$")
    number = F.col("host").rlike(r"^[0-9.]+$")
    domain = F.when(number | (F.size(parts) < 2), F.col("host")).when(deep, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))
    suffix = F.when(number, "").when(deep, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.element_at(parts, -1))
    return pages.withColumn("host", host).withColumn("domain", domain).withColumn("suffix", suffix)


def _logs(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(x))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **fit) -> DataFrame:
    """Per page ``id, lang, posterior, text_lang, declared, host`` and the evidence of each kind for ``lang``.

    ``e_suffix`` is the prior of the address suffix, ``e_host`` what domain and host add to it.
    Null markup is an empty text, null addresses share the empty host, an undeclared language is a value of its own.
    String ids must be numbers. Ties go to the first language by name. Repeated rows each give a row. Without labelled documents ``lang`` is null.
    """
    langs, table = fit_text(docs, **fit)
    n = len(langs)
    model = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # languages x BUCKETS

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series) -> pd.Series:
        out = []
        for html in texts:
            grams = _trigrams(visible(html))
            ll = model.value[:, grams].mean(axis=1) * min(len(grams), EVIDENCE) if len(grams) else np.zeros(n)
            out.append([float(x) for x in ll])
        return pd.Series(out)

    lang = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = address(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias(html_col)), url_col)
    rows = rows.select("id", "host", "domain", "suffix", lang.alias("declared"), likelihood(html_col).alias("ll"))
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", *[F.lit(None).cast("double").alias(c) for c in ("e_text", "e_declared", "e_suffix", "e_host")])
    top = F.array_max("ll")
    soft = F.transform("ll", lambda x: F.exp(x - top))
    total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    rows = cut(rows.withColumn("w", F.transform(soft, lambda x: x / total)))
    weigh = [F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(n)]
    listed = F.array(*[F.col(f"w{k}") for k in range(n)])
    even = F.array(*[F.lit(1.0 / n)] * n)

    def smooth(counts: Column, parent: Column) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + SMOOTH * p) / (size + SMOOTH))

    # grouped counts: hosts first, their parents from them, so every page is read once; partial sums take hot hosts
    hosts = rows.groupBy("host", "domain", "suffix").agg(*weigh).select("host", "domain", "suffix", listed.alias("n_host"))
    up = [F.sum(F.col("n_host")[k]).alias(f"w{k}") for k in range(n)]
    domains = hosts.groupBy("domain", "suffix").agg(*up).select("domain", "suffix", listed.alias("n_domain"))
    again = [F.sum(F.col("n_domain")[k]).alias(f"w{k}") for k in range(n)]
    suffixes = cut(domains.groupBy("suffix").agg(*again).select("suffix", listed.alias("n_suffix")))
    whole = suffixes.agg(*[F.sum(F.col("n_suffix")[k]).alias(f"w{k}") for k in range(n)]).first()
    total = F.array(*[F.lit(float(x or 0.0)) for x in whole])
    # one row a host with its own counts and its parents'
    priors = hosts.join(domains.select("domain", "suffix", "n_domain"), ["domain", "suffix"]).join(suffixes, "suffix").select("host", "n_host", "n_domain", "n_suffix")
    declared = cut(rows.groupBy("declared").agg(*weigh).select("declared", listed.alias("n_declared")))
    held = declared.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("declared")).alias("chars")).first()
    seen = held.n
    if seen * 8 * (n + 8) + (held.chars or 0) <= BROADCAST_BYTES:
        declared = F.broadcast(declared)  # its values are few, and most pages share one

    def others(counts: Column) -> Column:  # without the page itself, whose weight may differ in the last digits of a sum
        return F.zip_with(counts, F.col("w"), lambda c, x: F.greatest(c - x, F.lit(0.0)))

    full = rows.join(priors, "host").join(declared, "declared")
    full = full.withColumn("p_suffix", smooth(others(F.col("n_suffix")), smooth(others(total), even)))
    full = full.withColumn("p_host", smooth(others(F.col("n_host")), smooth(others(F.col("n_domain")), F.col("p_suffix"))))
    given = F.zip_with(others(F.col("n_declared")), others(total), lambda c, t: F.log((c + 0.5) / (t + 0.5 * (seen + 1))))
    full = full.withColumn("declared_log", given).withColumn("suffix_log", _logs(F.col("p_suffix")))
    full = full.withColumn("host_log", F.zip_with("p_host", "p_suffix", lambda x, y: F.log(x / y)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    full = full.withColumn("s", plus(plus(F.col("ll"), F.col("host_log")), plus(F.col("declared_log"), F.col("suffix_log"))))
    best = F.array_max("s")
    at = F.array_position("s", best).cast("int")
    posterior = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda c: F.element_at(F.col(c), at)
    return full.select(
        F.col("id").alias(id_col), F.element_at(names, at).alias("lang"), posterior.alias("posterior"), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
        "declared", "host", pick("ll").alias("e_text"), pick("declared_log").alias("e_declared"), pick("suffix_log").alias("e_suffix"), pick("host_log").alias("e_host"),
    )
