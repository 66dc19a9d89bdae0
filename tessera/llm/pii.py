"""Personal data: patterns with checks, and information-theoretic sanitisation of what gives it away.

Base findings are emails, IPv4 addresses, payment cards and phone numbers. Beyond them, a term may disclose an entity
(an email address, a phone number and so on) because it stands near that entity and hardly anywhere else. With
P(e) the share of documents that hold entity e and P(e|t) the share of documents with term t that hold e near t, knowing t
gives PMI(e; t) = log(P(e|t) / P(e)) of e's information IC(e) = -log P(e). A term whose disclosure PMI / IC reaches
``GENERALISE`` is replaced by a general word, one that reaches ``REMOVE`` is taken out. Everything is DataFrame
operations: corpus counts are grouped aggregations, and only terms with enough independent support are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive ends make the patterns iterate, where long runs would otherwise exhaust the stack; matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_WORD = r"\p{L}[\p{L}\p{N}_]{2,}"
#: Characters on either side of an entity in which terms are looked for.
CONTEXT = 120
#: Differing texts, and differing contexts, in which an entity must stand, and a term near it.
SUPPORT = 3
GENERALISE, REMOVE = 0.7, 0.9
#: Terms that are broadcast to be looked up; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
_NO_ID = -(2**63)
_SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _good(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(_OCTET))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: _good(kind, span["value"])


def _spans(text: Column, pattern: Column, kind: int) -> Column:
    """All matches, left to right, as (start, kind, stop, value); pieces between matches give the places."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def base_spans(text: Column) -> Column:
    """Checked base findings, sorted by start, then kind. Offsets count code points, the stop is exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = []
    for k, kind in enumerate(KINDS[:4]):
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINTS[kind])
        got = F.filter(_spans(text, F.lit(PATTERNS[kind]), k), _checked(kind))
        found.append(F.when(hint, got).otherwise(none))
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    """One spelling for an entity: lower case for addresses, digits for the rest."""
    return F.when(span["kind"] <= 1, F.lower(span["value"])).otherwise(F.concat(span["kind"].cast("string"), F.lit(":"), F.regexp_replace(span["value"], "[^0-9]", "")))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """``(term, disclosure)`` for terms whose disclosure of some entity reaches ``GENERALISE``.

    ``docs`` has ``d, th, t, base`` (id, hash of the text, text, base spans). All shares are of documents. An entity must
    stand in ``SUPPORT`` differing texts and contexts, and a term near it too: neither one document that names an entity
    often nor copies and edits of one text make a term. ``kind`` is that of the entity which it discloses most.
    """
    near = docs.where(F.size("base") > 0).select("d", "th", "t", F.explode("base").alias("s")).withColumn("kind", F.col("s.kind"))
    left = F.expr(f"substring(t, greatest(s.start - {CONTEXT}, 0) + 1, least(s.start, {CONTEXT}))")
    right = F.expr(f"substring(t, s.stop + 1, {CONTEXT})")
    around = F.lower(F.concat(left, F.lit(" \n "), right))
    near = near.select(F.struct("d", "th").alias("doc"), _entity(F.col("s")).alias("e"), "kind", around.alias("around"))
    near = cut(near.select("doc", "e", "kind", F.xxhash64("around").alias("ctx"), F.array_distinct(F.regexp_extract_all("around", F.lit(_WORD), F.lit(0))).alias("words")))
    often = F.least(F.count_distinct("ctx"), F.count_distinct("doc.th")).alias("c")
    entities = near.groupBy("e").agg(F.count_distinct("doc").alias("n_e"), often).where(F.col("c") >= SUPPORT)
    entities = cut(entities.select("e", "n_e"))
    pairs = near.join(entities.select("e"), "e", "left_semi").select("e", "kind", "ctx", "doc", F.explode("words").alias("term"))
    pairs = pairs.groupBy("e", "term").agg(often, F.count_distinct("doc").alias("n_et"), F.min("kind").alias("kind")).where(F.col("c") >= SUPPORT)
    pairs = cut(pairs.join(entities, "e").select("e", "term", "n_e", "n_et", "kind"))
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"), "kind")
    # counted before the join: tasks add up their own words, and the join sees each word of the corpus once
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))).alias("term"))
    seen = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    p_e = F.col("n_e") / F.lit(max(2, docs.count()))
    p_et = F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))  # repeated rows are one document near an entity, but count in n_t each
    share = F.when(p_e < 1, F.log(p_et / p_e) / -F.log(p_e)).otherwise(F.lit(0.0))
    found = pairs.join(seen, "term").groupBy("term").agg(F.max(F.struct(share.alias("disclosure"), (-F.col("kind")).alias("k"))).alias("x"))
    found = found.select("term", "x.disclosure", (-F.col("x.k")).alias("kind"))
    return found.where(F.col("disclosure") >= GENERALISE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base kinds, ``base_sha256``, ``spans``, ``n_terms`` and the ``sanitised`` text.

    Null texts count as empty; rows without an id and repeated rows each give a row. In ``sanitised``, base findings
    become ``[EMAIL]`` and so on, terms that disclose much go, those that disclose less become ``[TERM:EMAIL]`` and so on, by the kind that they give away; a finding
    that begins inside an earlier one is covered by it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("d", F.xxhash64("t").alias("th"), "t", base_spans(F.col("t")).alias("base"))
    found = cut(disclosing_terms(rows))
    n_terms = found.count()
    if n_terms:
        held = F.broadcast(found) if n_terms <= BROADCAST_TERMS else found
        words = rows.select("d", "th", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))).alias("term"))
        hits = words.join(held, "term").groupBy("d", "th").agg(F.collect_set(F.struct("term", "disclosure", "kind")).alias("terms"))
        # by id and text: copies of a text under other ids are dealt over all tasks
        rows = rows.join(hits.select(F.col("d").alias("hd"), F.col("th").alias("hh"), "terms"), F.col("d").eqNullSafe(F.col("hd")) & (F.col("th") == F.col("hh")), "left")
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<term:string,disclosure:double,kind:int>>"))
    base_at = F.col("base")

    def places(x: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), x["term"], F.lit(r"\E(?![\p{L}\p{N}_])"))
        clear = F.filter(_spans(F.col("t"), pattern, 4), lambda s: ~F.exists(base_at, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        to = F.when(x["disclosure"] >= REMOVE, F.lit("")).otherwise(F.concat(F.lit("[TERM:"), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)), F.lit("]")))
        return F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), to.alias("value")))

    none = F.array().cast(f"array<{_SPAN}>")
    terms = F.when(F.col("terms").isNull(), none).otherwise(F.flatten(F.transform("terms", places)))
    names = F.array(*[F.lit(k) for k in KINDS])
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.select("d", "t", "base", F.array_sort(F.concat("base", terms)).alias("all"))
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])))

    def write(acc: Column, s: Column) -> Column:
        to = F.when(s["kind"] == 4, s["value"]).otherwise(F.element_at(marks, s["kind"] + 1))
        kept = F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], kept, to).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    done = F.aggregate("all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), write)
    rows = rows.withColumn("done", F.when(F.size("all") > 0, done))
    clean = F.when(F.col("done").isNull(), F.col("t")).otherwise(F.concat(F.col("done.out"), F.expr("substring(t, done.at + 1)")))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return rows.select(F.col("d").alias(id_col), *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(shown("base"), 256).alias("base_sha256"), shown("all").alias("spans"), count(4).alias("n_terms"), clean.alias("sanitised"))
