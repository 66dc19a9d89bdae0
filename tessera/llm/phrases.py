"""Substring dedup by repeated-phrase automata.

A window is 13 consecutive words; a word goes if a window over it also starts in a document with a smaller id.

1. Anchors: of the 7-word phrases in each window, that of the smallest hash. Equal windows have equal anchors, so a
   window can recur only where its anchor does. An anchor's home is its first document and place.
2. Passages: documents hand the words around anchors at home to the home's shard, where their phrases become an
   Aho-Corasick automaton; all other documents with such anchors stream the words around them through it. What
   matches is extended word by word, and counts from 13 words on.
3. Windows whose anchor is at home in a document that goes on differently are confirmed one by one: they are grouped by
   a digest of their words, and the first holder of each is found.

Anchors only choose what is looked at; hashes of 64 bits that agree by chance cost time and change nothing. Shards
hold a bounded number of phrases; one that many documents stream through is cut into parts, each with its phrases.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import checkpoint_dir, cut

WINDOW, PHRASE = 13, 7
#: Words on each side of a phrase that its windows reach.
AROUND = WINDOW - PHRASE
#: Phrases of a shard, about, and anchors that stream through one part of it.
SHARD_PHRASES, PART_ANCHORS = 20_000, 200_000
#: Places of a document whose anchors are at home in one shard, so that a long document is several.
HOME_PLACES = 4096
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def split(text: bytes | str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    text = text or b""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def anchors(words: list[bytes], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's anchors: in every window, a phrase of its smallest hash.

    That is the first of equals, but a phrase that repeats itself in close steps is taken only as often as windows ask.
    """
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - PHRASE + 1
    h = np.zeros(n, np.uint64)
    for j in range(PHRASE):
        h = h * _MUL + own[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * _MUL
    h ^= h >> np.uint64(32)
    least = h[: n - AROUND].copy()
    at = np.arange(n - AROUND)
    for j in range(1, AROUND + 1):
        less = h[j : j + n - AROUND] < least
        least[less] = h[j : j + n - AROUND][less]
        at[less] = np.flatnonzero(less) + j
    at = np.unique(at)
    if (h[at[1:]] == h[at[:-1]]).any():
        kept, hashed = [at[0]], h[at]
        for k in range(1, len(at)):
            # between two equal phrases that every window over this one meets
            spare = k + 1 < len(at) and hashed[k] == h[kept[-1]] and hashed[k] == hashed[k + 1] and at[k + 1] - kept[-1] <= AROUND + 1
            if not spare:
                kept.append(at[k])
        at = np.array(kept)
    return at, h[at]


def once(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int] | None]]:
    """A document's anchors as ``(hashes, first places, further places)``, so that each is one row of the document."""
    order = np.argsort(hashes, kind="stable")
    held, first, n = np.unique(hashes[order], return_index=True, return_counts=True)
    again: list[list[int] | None] = [None] * len(held)
    for k in np.flatnonzero(n > 1).tolist():
        again[k] = places[order[first[k] + 1 : first[k] + n[k]]].tolist()
    return held, places[order[first]], again


def stretches(places: list[int], n: int) -> Iterator[tuple[int, int, list[int]]]:
    """The words around anchors as ``(start, stop, places)``, overlapping ones together; places count from the start."""
    start = stop = -1
    held: list[int] = []
    for p in places:
        lo, hi = max(0, p - AROUND), min(n, p + WINDOW)
        if lo > stop or not held:
            if held:
                yield start, stop, [q - start for q in held]
            start, held = lo, []
        stop = hi
        held.append(p)
    if held:
        yield start, stop, [q - start for q in held]


class Phrases:
    """Phrases of a shard with what stands around them at home, and the automaton that finds them."""

    def __init__(self) -> None:
        self.around: dict[str, dict[tuple, int]] = {}
        self.automaton = None

    def add(self, home: int, words: list[str], places: list[int]) -> None:
        for p in places:
            phrase = f" {' '.join(words[p : p + PHRASE])} "
            sides = tuple(words[max(0, p - AROUND) : p][::-1]), tuple(words[p + PHRASE : p + WINDOW])
            held = self.around.setdefault(phrase, {})
            held[sides] = min(home, held.get(sides, home))

    def compile(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, sides in self.around.items():
            self.automaton.add_word(phrase, (len(phrase), list(sides.items())))
        self.automaton.make_automaton()

    def occurrences(self, doc: int, words: list[str]) -> Iterator[tuple[int, int]]:
        """``(start, stop)`` of the words that a document has in common with an earlier one, from 13 words on."""
        at, begins = 0, {}
        for k, word in enumerate(words):
            begins[at] = k
            at += len(word) + 1
        for end, (size, homes) in self.automaton.iter(f" {' '.join(words)} "):
            q = begins[end - size + 1]
            for (left, right), home in homes:
                if home < doc:
                    back = ahead = 0
                    while back < len(left) and q > back and words[q - back - 1] == left[back]:
                        back += 1
                    while ahead < len(right) and q + PHRASE + ahead < len(words) and words[q + PHRASE + ahead] == right[ahead]:
                        ahead += 1
                    if back + ahead >= AROUND:
                        yield q - back, q + PHRASE + ahead
                    if back + ahead == 2 * AROUND:
                        break


def _anchored(rows: DataFrame) -> DataFrame:
    """``(id, places, shards, own)`` of documents with recurring anchors; own ones are at home in the document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for part in batches:
            found = [once(*anchors(split(t), hashes)) for t in part["t"]]
            n = [len(p) for p, _, _ in found]
            if sum(n):
                g, places = (np.concatenate(x) for x in list(zip(*found))[:2])
                again = [x for _, _, more in found for x in more]
                yield pd.DataFrame({"g": g.view(np.int64), "id": np.repeat(part["id"].to_numpy(np.int64), n), "p": places.astype(np.int32), "again": pd.Series(again, dtype=object)})

    found = rows.where("named").select("id", "t").mapInPandas(find, "g long, id long, p int, again array<int>")
    same = Window.partitionBy("g")
    found = found.select("g", "id", "p", "again", F.min(F.struct("id", "p")).over(same).alias("home"), F.max("id").over(same).alias("last")).where("home.id < last")
    by_home = F.xxhash64(F.col("home.id"), F.floor(F.col("home.p") / HOME_PLACES))
    found = found.select("id", "home", F.explode(F.concat(F.array("p"), F.coalesce("again", F.array().cast("array<int>")))).alias("p"))
    one = F.struct("p", by_home.alias("home"), (F.col("id") == F.col("home.id")).alias("own"))
    lists = found.select("id", one.alias("x")).groupBy("id").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return lists.select("id", F.col("x.p").alias("places"), F.col("x.home").alias("homes"), F.col("x.own").alias("own"))


def _marked(rows: DataFrame, anchored: DataFrame) -> DataFrame:
    """Documents beside their anchors, as a table in buckets of ids. What has none is done: its digest stands for its text."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            words = [split(t) for t in part["t"]]
            none = part["places"].isna()
            yield part.assign(n_words=[len(w) for w in words], sha=[hashlib.sha256(b" ".join(w)).hexdigest() if x else None for w, x in zip(words, none)], t=part["t"].where(~none, None))

    schema = "id long, named boolean, th long, t string, places array<int>, homes array<long>, own array<boolean>, n_words long, sha string"
    full = rows.join(anchored.withColumnRenamed("id", "aid"), F.col("named") & (F.col("id") == F.col("aid")), "left")
    full = full.select("id", "named", F.xxhash64("t").alias("th"), "t", "places", "homes", "own").mapInPandas(mark, schema)
    spark, name = rows.sparkSession, f"phrases_{uuid.uuid4().hex}"
    # a table in as many buckets as a shuffle has partitions: the last join reads it without moving a text again
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full.write.bucketBy(width, "id").option("path", f"{checkpoint_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _dealt(marked: DataFrame) -> DataFrame:
    """Stretches of words by shard and part: passages at home (``own``), which go to all parts, and those to look through."""
    held = marked.where("places IS NOT NULL")
    n = held.select(F.sum(F.size(F.filter("own", lambda x: x)))).first()[0] or 0
    shards = -(-n // SHARD_PHRASES) or 1

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shard", "own", "id", "th", "start", "t", "at"]
        for part in batches:
            out = []
            for doc, th, text, places, homes, own in zip(part["id"], part["th"], part["t"], part["places"], part["homes"], part["own"]):
                words = split(text)
                by: dict[tuple[int, bool], list[int]] = {}
                for p, home, mine in zip(places.tolist(), homes.tolist(), own.tolist()):
                    if p + PHRASE <= len(words):  # rows that share an id share their anchors
                        by.setdefault((home % shards, mine), []).append(p)
                for (shard, mine), ps in by.items():
                    for lo, hi, at in stretches(ps, len(words)):
                        out.append((shard, mine, doc, th, lo, b" ".join(words[lo:hi]).decode("utf-8", "surrogatepass"), at))
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    rows = held.select("id", "th", "t", "places", "homes", "own").mapInPandas(cut_out, "shard long, own boolean, id long, th long, start int, t string, at array<int>")
    sizes = held.select(F.explode(F.arrays_zip("homes", "own")).alias("x")).where("NOT x.own").groupBy(F.pmod("x.homes", F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes.select("shard", F.ceil(F.col("n") / PART_ANCHORS).cast("int").alias("parts")))
    parts = F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "start"), F.col("parts")).cast("int")))
    return rows.join(sizes, "shard").select("shard", F.explode(parts).alias("part"), "own", "id", "th", "start", "t", "at")


def _located(dealt: DataFrame) -> DataFrame:
    """``(id, th, spans, rest)``: located words, and windows at anchors that no passage at home explains, with digests."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = Phrases(), None
        for part in batches:
            out = []
            for shard, piece, own, doc, th, start, text, at in part[["shard", "part", "own", "id", "th", "start", "t", "at"]].itertuples(index=False):
                if (shard, piece) != now:
                    held, now = Phrases(), (shard, piece)
                words, places = text.split(" "), at.tolist()
                if own:
                    held.add(doc, words, places)
                    continue
                if held.automaton is None:
                    held.compile()
                n = len(words)
                gone, known, asked = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
                for lo, hi in held.occurrences(doc, words):
                    gone[lo:hi] = True
                    known[lo : hi - WINDOW + 1] = True
                for q in places:
                    asked[max(0, q - AROUND) : q + 1] = True
                asked[max(0, n - WINDOW + 1) :] = False
                rest = np.flatnonzero(asked & ~known)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))) + start
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(words[s : s + WINDOW]).encode("utf-8", "surrogatepass")) for s in rest.tolist()), np.int64).reshape(-1, 2)
                out.append((doc, th, edges[::2], edges[1::2], rest + start, digests[:, 0], digests[:, 1]))
            yield pd.DataFrame(out, columns=["id", "th", "lo", "hi", "s", "h1", "h2"])

    width = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(width, "shard", "part").sortWithinPartitions("shard", "part", F.desc("own"))
    return sorted_.mapInPandas(look, "id long, th long, lo array<int>, hi array<int>, s array<int>, h1 array<long>, h2 array<long>")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``(id, n_words, n_removed, kept_sha256, kept)``: ``kept`` has the words that stay, joined by one space,
    where some go; it is null where the text's words all stay.

    Null and empty texts have no words. Rows without an id neither lose words nor make others lose them. Rows that share
    an id are one document to others and are judged each by itself, so repeated rows give equal rows. Windows are
    judged on the input. Other columns are not read; an empty table gives no rows.
    """
    own_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own_id, F.lit(0).cast("long")).alias("id"), own_id.isNotNull().alias("named"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    marked = _marked(rows, _anchored(rows))
    found = cut(_located(_dealt(marked)), "zstd")
    rest = found.select("id", "th", F.explode(F.arrays_zip("s", "h1", "h2")).alias("x")).select("id", "th", "x.s", "x.h1", "x.h2")
    first = rest.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first")
    late = rest.join(first, ["h1", "h2"]).where("id > first").select("id", "th", F.col("s").alias("lo"), (F.col("s") + WINDOW).alias("hi"))
    spans = found.select("id", "th", F.explode(F.arrays_zip("lo", "hi")).alias("x")).select("id", "th", "x.lo", "x.hi").unionByName(late)
    spans = spans.groupBy("id").agg(F.collect_set(F.struct("th", "lo", "hi")).alias("x"))
    spans = spans.select(F.col("id").alias("sid"), F.col("x.th").alias("ths"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, named, th, text, n, sha, ths, lo, hi in part[["id", "named", "th", "t", "n_words", "sha", "ths", "lo", "hi"]].itertuples(index=False):
                removed, kept = 0, None
                if sha is None:
                    words = split(text)
                    stay = np.ones(len(words), bool)
                    if ths is not None:
                        for k in np.flatnonzero(ths == th):
                            stay[lo[k] : hi[k]] = False
                    removed = int((~stay).sum())
                    left = b" ".join([w for w, x in zip(words, stay.tolist()) if x]) if removed else b" ".join(words)
                    sha = hashlib.sha256(left).hexdigest()
                    kept = left.decode("utf-8", "surrogatepass") if removed else None
                out.append((doc, named, n, removed, sha, kept))
            yield pd.DataFrame(out, columns=["id", "named", "n_words", "n_removed", "kept_sha256", "kept"])

    done = marked.select("id", "named", "th", "t", "n_words", "sha").join(spans, F.col("named") & (F.col("id") == F.col("sid")), "left").drop("sid")
    done = done.mapInPandas(finish, "id long, named boolean, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(F.when(F.col("named"), F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


#: The same by a group for each window's words.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS s FROM d) x WHERE doc_id IS NOT NULL),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT r, s + u.o AS i FROM g JOIN f ON g.k = f.k AND g.doc_id > f.first CROSS JOIN (SELECT unnest(range(0, 13)) AS o) u),
n AS (SELECT r, count(*) AS removed, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed,
    sha256(array_to_string(CASE WHEN removed IS NULL THEN w ELSE list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'x': w[i]}), lambda y: NOT list_contains(gone, y.i)), lambda y: y.x) END, ' ')) AS kept_sha256
FROM d LEFT JOIN n USING (r)"""
