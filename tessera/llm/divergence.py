"""Source divergence audit: how far the sources of a language differ in their terms, by pair tasks on sorted counts.

Terms of a language that stand in enough of its documents get ids, dealt over shards so that no array grows past a
bound. For every unordered pair of sources and every shard, the two sorted (term id, count) arrays are co-grouped and
merged: a galloping intersection finds what both hold, and overlaps, one-sided and absent terms are priced in both
directions. Absent terms cost one multiplication. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import cut

#: Documents of a language that a kept term stands in, at least.
LEAST_DOCS = 3
#: Kept terms of a shard, about: the length that one pair task's arrays can reach.
SHARD_TERMS = 1 << 16
#: Ranks of terms that are returned for each group (a top-k report).
TOP = 200
SCALE = 1_000_000_000
#: Entries that a task counts before it hands them on.
HELD = 600_000
DOC = 1 << 40
_SAFE = 2**63 // SCALE - 2
#: Bytes to term bytes: A-Z lowered, other ASCII but a-z to spaces.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters outside ASCII, A-Z lowered, in UTF-8."""
    return text.translate(_TERM_BYTES).split()


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for every count."""
    out = 1 + (counts + 1) * SCALE // total
    for i in np.flatnonzero(counts >= _SAFE):
        out[i] = 1 + (int(counts[i]) + 1) * SCALE // total
    return out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ids of two sorted arrays; each id of the shorter is searched for in the longer."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(long, short)
    hit = long[np.minimum(at, len(long) - 1)] == short
    return np.flatnonzero(hit), at[hit]


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int, total_a: int, total_b: int) -> tuple[int, int]:
    """Divergence of a from b and of b from a over the ``size`` terms of a shard; arrays are ids and counts."""
    if len(a[0]) > len(b[0]):
        return price(b, a, size, total_b, total_a)[::-1]
    in_a, in_b = gallop(a[0], b[0])
    none_a, none_b = share(np.zeros(1, np.int64), total_a), share(np.zeros(1, np.int64), total_b)
    p, q = share(a[1], total_a), share(b[1], total_b)
    only_a, only_b = np.delete(p, in_a), np.delete(q, in_b)
    absent = size - len(p) - len(q) + len(in_a)
    there = int(gap(p[in_a], q[in_b]).sum()) + int(gap(only_a, none_b).sum()) + int(gap(none_a, only_b).sum()) + absent * int(gap(none_a, none_b)[0])
    back = int(gap(q[in_b], p[in_a]).sum()) + int(gap(none_b, only_a).sum()) + int(gap(only_b, none_a).sum()) + absent * int(gap(none_b, none_a)[0])
    return there, back


def _counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` of ``docs`` (``lang, source, t``); every group also has a row without a term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's documents, times DOC, plus its occurrences

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), own in held.items():
                yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *own], "n": [0, *(v % DOC for v in own.values())], "docs": [0, *(v // DOC for v in own.values())]})
            held.clear()

        entries = 0
        for part in batches:
            for lang, source, text in zip(part["lang"], part["source"], part["t"]):
                own = held.setdefault((lang, source), {})
                entries -= len(own)
                known = own.get
                for term, n in Counter(terms(text)).items():
                    own[term] = known(term, 0) + n + DOC
                entries += len(own)
                if entries > HELD:
                    yield from out()
                    entries = 0
        yield from out()

    rows = docs.mapInPandas(count, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """:func:`share` of two columns; decimals, as 10^9 times a count may pass 64 bits."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({total} AS DECIMAL(19, 0))")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _term_part(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """What a group says more often than its language does, the ``top`` terms of each group."""
    rows = counts.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("n_lang", "lang_total").alias("q")).where("p > q")
    # Spark keeps the first ``top`` of a group in each task before it shuffles them
    return _ranked(rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")), "term").where(F.col("rank") <= top)


def _pair_part(counts: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """The divergence of every group from each other one of its language: a task for each unordered pair and shard."""
    listed = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = counts.groupBy("lang", "source", "shard").agg(listed.alias("x")).select("lang", "source", "shard", F.col("x.id").alias("ids"), F.col("x.n").alias("ns"))
    whole = groups.select("lang", "source", "total").join(sizes, "lang").join(arrays, ["lang", "source", "shard"], "left")
    whole = cut(whole.select("lang", "source", "shard", "size", "total", "ids", "ns"))
    names = groups.select("lang", "source")
    pairs = names.withColumnRenamed("source", "a").join(names.withColumnRenamed("source", "b"), "lang").where("a < b")
    first = whole.withColumnRenamed("source", "a").join(pairs, ["lang", "a"])
    second = whole.withColumnRenamed("source", "b").join(pairs, ["lang", "b"])
    second = second.select(*[F.col(c).alias(c) for c in second.columns])  # the same table twice: columns of their own

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def arrays(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (row["ids"], row["ns"]))

        a, b = left.iloc[0], right.iloc[0]
        there, back = price(arrays(a), arrays(b), int(a["size"]), int(a["total"]), int(b["total"]))
        return pd.DataFrame({"lang": [a["lang"]], "a": [a["a"]], "b": [a["b"]], "there": [there], "back": [back]})

    keys = ["lang", "a", "b", "shard"]
    priced = first.groupBy(*keys).cogroup(second.groupBy(*keys)).applyInPandas(task, "lang string, a string, b string, there long, back long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    # a language that keeps no term has no shard, and its pairs differ by nothing
    priced = pairs.join(priced, ["lang", "a", "b"], "left")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value"))))
    rows = priced.select("lang", both.alias("x")).select("lang", "x.source", "x.item", F.coalesce("x.value", F.lit(0).cast("long")).alias("value"))
    return _ranked(rows, "pair")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` (all other sources) and ``term`` (the ``top`` terms).

    Null text, language and source read as empty. Every row is a document of its own, repeated ones too. A group
    without a kept term prices all terms as absent; a language without kept terms has pairs of value 0 and no terms; an
    empty table gives no rows. Ties go to the smaller item in UTF-8 order. Other columns are not read.
    """
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "t").cast("binary").alias("t"))
    found = cut(_counted(rows))
    kept = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "n_lang"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), (F.sum("n_lang") + F.count(F.lit(1))).alias("lang_total"))
    most = langs.agg(F.max("v")).first()[0] or 0
    shard = F.pmod(F.xxhash64("term"), F.lit(-(-most // shard_terms) or 1)).cast("int")
    place = Window.partitionBy("lang", "shard").orderBy("term")
    numbered = cut(kept.withColumn("shard", shard).withColumn("id", F.row_number().over(place)))
    sizes = numbered.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("size"))
    counts = cut(found.where("term IS NOT NULL").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]).select("lang", "source", "term", "shard", "id", "n", "n_lang"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_kept"))
    groups = found.where("term IS NULL").select("lang", "source").join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = cut(groups.select("lang", "source", (F.coalesce("n_kept", zero) + F.coalesce("v", zero)).alias("total"), "lang_total"))
    return _pair_part(counts, groups, sizes).unionByName(_term_part(counts, groups, top))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same by plain joins over all terms of all groups.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_AZ}', '{_AZ.lower()}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS nl FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (nl + 1)) // (sum(nl) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS HUGEINT) AS ql FROM s),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - ql) * (p - ql) // ql AS BIGINT) FROM p WHERE n > 0 AND p > ql)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 200"""
