"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line is lower-cased and trimmed. Lines are alike where the Jaccard index of their ``SHINGLE``-character shingles
reaches a threshold. Signatures hold minima over hashes of shingles that the content itself picks: those that begin at
an anchor, a character whose last UTF-8 byte is 1 modulo ``ANCHOR_MOD`` (about one in six, in any script), each
taken from the end of the one before. A line with few anchors has minima over all its shingles instead, and one in
between has both, so that lines of about the threshold always have a kind in common. One hash of a shingle serves all
minima: the k-th minimum is that of the hash XOR a constant. Rows of minima make bands; lines that share a band, and
agree in three bits of most minima, are candidates. They are verified by the exact Jaccard index of all shingles, and
distributed union-find joins what is verified. Of each component the first line (by document id, then position) stays.

Within a band's bucket every line is compared first with the one that stands most often in the corpus, which variants
of a line have in common, so groups of near-copies fall together for n comparisons. Then each line outside of the
bucket's largest component is compared with all lines of other components, in pairs of blocks: no pair of a bucket is
left out unless it is joined already. That first line takes no part in it, so a bucket of two is done. Lines of crowded
buckets are compared there by parity sketches of all their shingles first. Two sketches differ in at most as many bits as the sets differ in shingles, so a pair that differs in
more bits than the threshold allows shingles cannot be alike: the sketch passes over such pairs and never over a link.
Only lines whose code is like another's in a crowded bucket get a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.plans.session import cut

SHINGLE = 5
BANDS, ROWS = 7, 3
#: Minima of which three bits are kept, and how many of those must agree for a pair to be verified.
CODED, LEAST_MINIMA = 21, 14
SIMILARITY = 0.8
ANCHOR_MOD = 6
#: Lines with so many anchors have minima over anchored shingles, those with at most so many over all shingles.
LEAST_ANCHORS, FEW_ANCHORS = 7, 10
#: Line ids (8 bytes each) that are broadcast to find candidates' texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A bucket is cut into ``ceil(sqrt(n / BLOCK))`` blocks, and each pair of blocks is a group of its own. A comparison takes
#: nanoseconds and a row dealt out far more, so lines are dealt out by the root of their bucket, not by its size.
BLOCK = 1024
#: Buckets of more lines than this have parity sketches, of so many 64-bit words.
CROWD, SKETCH_WORDS = 16, 16
_NO_ID = -(2**63)


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _shingles(line: Column) -> Column:
    """Hashes of all windows of SHINGLE characters; a shorter line is one. UTF-32 makes a window a slice of bytes."""
    last = lambda u: F.greatest(F.length(u) - 4 * SHINGLE, F.lit(0)) + 1
    hashes = lambda u: F.transform(F.sequence(F.lit(1), last(u), F.lit(4)), lambda at: F.xxhash64(F.substring(u, at, F.lit(4 * SHINGLE))))
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), hashes), 1)


def _anchored(line: Column) -> Column:
    """Windows that begin at an anchor, from the UTF-8 bytes; a first character is known by its last byte."""
    anchor = "".join(f"\\x{b:02x}" for b in (*range(128), *range(128, 192)) if b % ANCHOR_MOD == 1)
    character = r"[\x00-\x7f\xc0-\xff][\x80-\xbf]*+"
    # most lines are ASCII, and most windows of others, which takes no search for last bytes
    rest = f"(?:[\\x00-\\x7f]{{{SHINGLE - 1}}}|{character * (SHINGLE - 1)})"
    plain = F.regexp_extract_all(line, F.lit(f"(?s)[{anchor}]{'.' * (SHINGLE - 1)}"), F.lit(0))
    other = F.regexp_extract_all(F.decode(line.cast("binary"), "ISO-8859-1"), F.lit(f"(?s)[{anchor}]{rest}"), F.lit(0))
    return F.when(F.octet_length(line) == F.char_length(line), plain).otherwise(other)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(d, th, pos, h1, h2, line)`` for each line that is not blank; ``d, th`` name a document by id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), text.alias("t"))
    rows = rows.select("d", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "raw"))
    rows = rows.where(F.trim("raw") != "").select("d", "th", "pos", normal(F.col("raw")).alias("line"))  # lowered once
    return rows.select("d", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _constants() -> list[int]:
    """A 32-bit constant for each minimum: a multiplicative sequence, which spreads over the range evenly."""
    return [((k + 1) * 0x9E3779B1 & 0xFFFFFFFF) - (1 << 31) for k in range(BANDS * ROWS)]


def signatures(lines: DataFrame) -> DataFrame:
    """Per line id and kind of shingles its band ``keys`` and ``code``, three bits of CODED minima. ``weight`` counts
    shingles over all places where the line stands.


    Minima are grouped in the task that reads the line before any shuffle.
    """
    # explode of one element holds a column that is used more than once, so that it is worked out once
    rows = lines.select("h1", "line", F.explode(F.array(F.transform(_anchored(F.col("line")), lambda s: F.xxhash64(s)))).alias("w"))
    some = F.when(F.size("w") >= LEAST_ANCHORS, F.col("w"))
    few = F.when(F.size("w") <= FEW_ANCHORS, _shingles(F.col("line")))
    # a column of its own for the array, which would else stand in every row that comes from it
    rows = rows.select("h1", F.posexplode(F.array(some, few)).alias("kind", "s"))
    rows = rows.select("h1", "kind", F.explode("s").alias("s")).select("h1", "kind", F.hash("s").alias("v"))
    minima = rows.groupBy("h1", "kind").agg(F.count(F.lit(1)).alias("weight"), *[F.min(F.col("v").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(_constants())])
    keys = [F.xxhash64(F.lit(b), "kind", *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    code = F.lit(0).cast("long")
    for k in range(CODED):
        code = F.shiftleft(code, 3).bitwiseOR(F.col(f"m{k}").bitwiseAND(F.lit(7)).cast("long"))
    return minima.select(F.col("h1").alias("a"), F.array(*keys).alias("keys"), code.alias("code"), "weight")


def _alike(p: Column, q: Column) -> Column:
    """Two codes agree in LEAST_MINIMA minima or more; of lines that are 0.8 alike, about 1 in 100 fail."""
    x = p.bitwiseXOR(q)
    x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(sum(1 << (3 * k) for k in range(CODED))))
    return F.bit_count(x) <= CODED - LEAST_MINIMA


def _texts(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """``(h1, line)`` of the line ids ``ids``: the smallest line of each."""
    ids = cut(ids)
    held = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return cut(lines.select("h1", "line").join(held, "h1").groupBy("h1").agg(F.min("line").alias("line")))


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of line ids whose lines have a Jaccard index of ``similarity`` or more, with the lines' second hashes."""
    texts = _texts(pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct(), lines)
    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(width, "a", "b")  # few bytes and much work a row: a small table would end in one task
    both = pairs.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h1").alias("b"), F.col("line").alias("lb")), "b")
    both = both.select("a", "b", F.xxhash64(F.lit(1), "la").alias("a2"), F.xxhash64(F.lit(1), "lb").alias("b2"), F.explode(F.array(F.struct(_shingles(F.col("la")).alias("p"), _shingles(F.col("lb")).alias("q")))).alias("x"))
    # sets are made in a step of their own, which has no lambda and so is compiled as a whole
    both = both.select("a", "b", "a2", "b2", F.explode(F.array(F.struct(F.array_distinct("x.p").alias("p"), F.array_distinct("x.q").alias("q")))).alias("x"))
    enough = lambda common: common * (1 + similarity) >= similarity * (F.size("x.p") + F.size("x.q"))
    return both.where(enough(F.least(F.size("x.p"), F.size("x.q"))) & enough(F.size(F.array_intersect("x.p", "x.q")))).select("a", "b", "a2", "b2")


def _sketches(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """Per line id the number ``m`` of its shingles and ``s0, s1, ..``, the parities of the shingles that fall on each bit."""
    rows = _texts(ids, lines).select("h1", F.explode(F.array(_shingles(F.col("line")))).alias("s")).select("h1", F.explode(F.array_distinct("s")).alias("s"))
    rows = rows.select("h1", F.pmod("s", F.lit(SKETCH_WORDS)).alias("k"), F.expr(f"shiftleft(1L, cast(pmod(s div {SKETCH_WORDS}, 64) as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("k") == k, F.col("bit"))), F.lit(0)).alias(f"s{k}") for k in range(SKETCH_WORDS)]
    return rows.groupBy(F.col("h1").alias("a")).agg(F.count(F.lit(1)).alias("m"), *words)


def _possible(similarity: float) -> Column:
    """Sizes and sketches leave room for ``similarity``."""
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    slack = 1e-6  # for rounding
    sizes = F.least("m", "bm") + slack >= similarity * F.greatest("m", "bm")
    return sizes & (apart * (1 + similarity) <= (1 - similarity) * (F.col("m") + F.col("bm")) + slack)


def _remainder(held: DataFrame, linked: DataFrame, pairs: DataFrame, lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` that share a bucket, have like codes, may be alike, are not yet joined by ``linked`` nor among ``pairs``.

    ``held`` has no bucket's first line, which all others of it have been compared with, and so none of buckets of two;
    ``n`` counts it. One end of each pair is outside of the largest component of its bucket. Buckets of more than ``BLOCK``
    lines are dealt out as pairs of blocks, so rows and groups grow with no more than the root of their bucket beside its
    lines. The second table has the pairs' lines.
    """
    width = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.join(linked.select(F.col("node").alias("a"), "component"), "a", "left").select("key", "a", "code", "n", F.coalesce("component", "a").alias("c"))
    bucket = Window.partitionBy("key")
    # one shuffle and one sort for all counts of a bucket
    rows = rows.repartition(width, "key").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key", "c")))
    rows = rows.select("key", "a", "code", "c", "n", F.min("c").over(bucket).alias("low"), F.max("c").over(bucket).alias("high"), F.max(F.struct("m", "c")).over(bucket).alias("most"))
    blocks = lambda n: F.ceil(F.sqrt(n / F.lit(BLOCK))).cast("int")
    sizes = [F.col("most.c").alias("big"), (F.col("n") > CROWD).alias("crowd"), blocks(F.col("n") - 1 - F.col("most.m")).alias("ni"), blocks(F.col("n") - 1).alias("nj")]
    dealt = cut(rows.where("low <> high").select("key", "a", "code", "c", *sizes))
    new = lambda met: met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    small = cut(new(_met(dealt.where("NOT crowd"), blocks=False)))
    # sketches only for lines that have like codes with another one in a crowded bucket
    crowded = dealt.where("crowd")
    found = cut(_met(crowded, "left_semi").select("key", "a").distinct())
    # the way back begins at what was found and stays in its buckets, which are few
    within = crowded.join(found.select("key").distinct(), "key", "left_semi")
    partners = _met(within, "left_semi", True, asking=within.join(found, ["key", "a"], "left_semi"))
    asked = cut(found.select("a").unionByName(partners.select(F.col("b").alias("a"))).distinct())
    texts = _texts(asked.unionByName(small.select("a")).unionByName(small.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "h1"), lines)
    keys = crowded.join(asked, "a").groupBy("a").agg(F.collect_set("key").alias("keys"))
    sketches = cut(_sketches(asked.select(F.col("a").alias("h1")), texts).join(keys, "a"))
    # a pair is given in the first bucket that it shares
    first = F.col("key") == F.array_min(F.array_intersect("keys", "bkeys"))
    large = new(_met(crowded.join(sketches, "a"), possible=_possible(similarity) & first))
    return small.unionByName(large).distinct(), texts


def _dealt(rows: DataFrame, n: str, block: str) -> DataFrame:
    """Each row once for each of ``n`` blocks, numbered in ``block``; rows of one block stay as they are."""
    many = rows.where(F.col(n) > 1).withColumn(block, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return rows.where(F.col(n) <= 1).withColumn(block, F.lit(0)).unionByName(many)


def _met(dealt: DataFrame, how: str = "inner", back: bool = False, possible: Column | None = None, blocks: bool = True, asking: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's lines of different components, ``a`` outside of the largest, with like codes; each in one order.

    A semi join gives the ``a`` that have such a ``b``, with ``back`` the ``b`` that have such an ``a``. The ``a`` are
    lines of ``asking``, all of ``dealt`` if it is not given. Columns of ``dealt`` beside those that :func:`_remainder` makes serve ``possible``; those of ``b`` begin
    with a b, words of sketches with a t. Small buckets take no ``blocks``: each is one.
    """
    each = lambda rows, n, block: _dealt(rows, n, block) if blocks else rows.withColumn(block, F.lit(0))
    mine = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int") if blocks else F.lit(0)
    more = [c for c in dealt.columns if c not in ("key", "a", "code", "c", "big", "crowd", "ni", "nj")]
    left = each((dealt if asking is None else asking).where("c <> big"), "nj", "j").select("key", mine("ni").alias("i"), "j", "a", "code", "c", "big", *more)
    right = each(dealt, "ni", "i").select("key", "i", mine("nj").alias("j"), F.col("a").alias("b"), F.col("code").alias("bcode"), F.col("c").alias("bc"), *[F.col(c).alias(f"t{c[1:]}" if c[1:].isdigit() else f"b{c}") for c in more])
    once = (F.col("bc") == F.col("big")) | (F.col("a") < F.col("b"))
    near = (F.col("c") != F.col("bc")) & once & _alike(F.col("code"), F.col("bcode"))
    for k in ("key", "i", "j"):
        right = right.withColumnRenamed(k, f"b_{k}")
    near = (F.col("key") == F.col("b_key")) & (F.col("i") == F.col("b_i")) & (F.col("j") == F.col("b_j")) & near
    near = near if possible is None else near & possible
    return right.join(left.hint("merge"), near, how) if back else left.join(right.hint("merge"), near, how)


def components(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(h1, h2, component)`` for each line, by its two hashes, that is joined to another one.

    Lines that share the first hash and differ in the second count as one here; only the smallest of them is joined.
    """
    sig = signatures(lines)
    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sig.select("a", "code", "weight", F.explode("keys").alias("key")).repartition(width, "key")
    # most lines are alone in a bucket and go before the rest is sorted
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    bucket = Window.partitionBy("key").orderBy(F.desc("weight"), "a").rowsBetween(Window.unboundedPreceding, 0)  # variants gather round the line that stands most often
    held = rows.select("key", "a", "code", "n", F.first("a").over(bucket).alias("b"), F.first("code").over(bucket).alias("bcode"))
    held = cut(held.where("a <> b"))
    near = held.where(_alike(F.col("code"), F.col("bcode")))
    pairs = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = cut(_verified(pairs, lines, similarity))
    rest, texts = _remainder(held.where("n > 2").select("key", "a", "code", "n"), connected_components(links, "a", "b"), pairs, lines, similarity)
    links = cut(links.unionByName(_verified(cut(rest), texts, similarity)))
    seconds = links.select("a", "a2").union(links.select("b", "b2")).distinct()
    return connected_components(links, "a", "b").join(seconds, F.col("node") == F.col("a")).select(F.col("a").alias("h1"), F.col("a2").alias("h2"), "component")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one line left of each group of equal or fuzzily equal lines; blank lines stay.

    The line that stays is the first by document id, then by position in its text; rows without an id come first.
    A document all of whose lines go stays with an empty text; a null text stays null. Rows that repeat both id and
    text are treated alike, as one document. Ids must be integers or spell integers. Columns and their order stay as
    they are, whatever their names. An empty table gives an empty one.
    """
    lines = cut(_lines(docs, id_col, text_col), "zstd")  # text is split and lowered once
    comp = components(lines, similarity)
    seen = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    joined = seen.join(comp, ["h1", "h2"], "left").where("n > 1 OR component IS NOT NULL")
    # a component has the number of one of its lines; the second hash keeps apart lines of their own with that number
    own = F.when(F.col("component").isNull(), F.col("h2"))
    joined = joined.select("h1", "h2", F.coalesce("component", "h1").alias("c"), own.alias("o"))
    places = cut(lines.select("d", "th", "pos", "h1", "h2").join(joined, ["h1", "h2"]).select("c", "o", "d", "th", "pos"))
    where = F.struct("d", "th", "pos")
    first = cut(places.groupBy("c", "o").agg(F.min(where).alias("keep")))
    same = places["c"].eqNullSafe(first["c"]) & places["o"].eqNullSafe(first["o"])
    drops = places.join(first, same).where(where != F.col("keep"))
    d, th, drop = (_fresh(docs, n) for n in ("d", "th", "drop"))
    drops = drops.groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_set("pos").alias(drop))
    rows = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), th: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows = rows.join(drops.hint("shuffle_hash"), [d, th], "left")  # no sort of whole texts
    pieces = F.split(F.col(text_col), "\n")
    left = F.concat_ws("\n", F.filter(pieces, lambda x, i: ~F.array_contains(F.col(drop), i)))
    return rows.select(*[F.when(F.col(drop).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name
