"""Spelling variants: words one edit apart, found by tries over letter-group counts.

Letters fall into groups, and a word is the vector of its counts per group. One inserted letter adds one to a count, one
deleted letter takes one away, one replaced letter does both or neither. Words stand in a trie by successive counts;
a depth-first search for a word spends one surplus and then, further down, one deficit. It never spends the deficit
first, as that pair is found from its other word, so every pair meets once. Leaf words are compared letter by letter.

The first levels of the trie name shards: every word stands in one, and asks in each shard that its budget can reach.
Their number is chosen by the largest shard; what is larger at the last level is cut into blocks, each asked by all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut

LEAST_LETTERS = 7
LEAST_USES = 2
#: A form is used so many times as often as the word, at least.
FORM_TIMES = 10
#: Letter groups: code points modulo this, so common letters fall apart.
GROUPS = 9
#: Words of a shard that one task holds as a trie.
SHARD_WORDS = 50_000
#: Letters at either end of a word by which a leaf finds those to verify: one edit leaves one of the ends alone.
ENDS = LEAST_LETTERS // 2
#: Entries that a task counts before it hands them on.
HELD = 300_000
#: Rows of a result batch.
CHUNK = 100_000
#: One in so many runs loses a letter, by a checksum of document and run.
NOISE = 31
#: Latin-1 bytes to letters: A-Z lowered, what is no letter to spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_GROUP = bytes(b % GROUPS for b in range(256))
_EACH = [bytes([g]) for g in range(GROUPS)]


def runs(text: str | None) -> list[bytes]:
    """Runs of letters that are long enough to count, A-Z lowered, a byte for each code point."""
    return [w for w in (text or "").encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= LEAST_LETTERS]


def noised(prefix: int, run: bytes) -> bytes:
    """The run, or the run without one letter where its checksum after the document's says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all words that are long and frequent enough. Null texts have none; a null id reads as empty."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for part in batches:
            for doc, text in zip(part["id"], part["t"]):
                prefix = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(runs(text)).items():
                    word = noised(prefix, run)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_USES)


def vector(word: str) -> tuple[int, ...]:
    """Letter counts by group."""
    return tuple(map(word.encode("latin-1").translate(_GROUP).count, _EACH))


def one_edit(short: str, long: str) -> bool:
    """Whether two different words, the second as long or one longer, are one inserted or replaced letter apart."""
    more, half = len(long) - len(short), len(short) // 2
    if short[:half] == long[:half]:
        at = half
        while at < len(short) and short[at] == long[at]:
            at += 1
        return short[at + 1 - more :] == long[at + 1 :]
    if short[half:] != long[half + more :]:
        return False
    at = 0
    while short[at] == long[at]:
        at += 1
    return short[at + 1 - more : half] == long[at + 1 : half + more]


def reach(counts: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Shards (first counts) that a word asks in, with its budget there: 2 both left, 1 a deficit left, 0 none."""
    yield counts, 2
    for i, c in enumerate(counts):
        more = (*counts[:i], c + 1, *counts[i + 1 :])
        yield more, 1
        for j in range(i + 1, len(counts)):
            if counts[j]:
                yield (*more[:j], counts[j] - 1, *more[j + 1 :]), 0


class Leaf:
    """Words of equal counts, by their first and by their last letters."""

    def __init__(self) -> None:
        self.first: dict[str, list[tuple[str, int]]] = {}
        self.last: dict[str, list[tuple[str, int]]] = {}

    def add(self, word: str, n: int) -> None:
        self.first.setdefault(word[:ENDS], []).append((word, n))
        self.last.setdefault(word[-ENDS:], []).append((word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Verified near words; the leaf's are as long as ``word`` or one longer."""
        for held in self.first.get(word[:ENDS], ()):
            if one_edit(word, held[0]):
                yield held
        for held in self.last.get(word[-ENDS:], ()):
            if held[0][:ENDS] != word[:ENDS] and one_edit(word, held[0]):
                yield held


class Trie:
    """Words of a shard by their further counts."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.found: dict[tuple[str, int], list[tuple[Leaf, int]]] = {}

    def add(self, counts: tuple[int, ...], word: str, n: int) -> None:
        node = self.root
        for c in counts[:-1]:
            node = node.setdefault(c, {})
        node.setdefault(counts[-1], Leaf()).add(word, n)

    def search(self, counts: tuple[int, ...], budget: int) -> Iterator[tuple[Leaf, int]]:
        """Leaves within the budget, depth first, with what is left of it."""
        depth, stack = len(counts), [(self.root, 0, budget)]
        while stack:
            node, k, left = stack.pop()
            if k == depth:
                yield node, left
                continue
            c = counts[k]
            if (child := node.get(c)) is not None:
                stack.append((child, k + 1, left))
            if left == 2:
                if (child := node.get(c + 1)) is not None:
                    stack.append((child, k + 1, 1))
            elif left == 1 and c and (child := node.get(c - 1)) is not None:
                stack.append((child, k + 1, 0))

    def leaves(self, counts: str, budget: int) -> list[tuple[Leaf, int]]:
        """The same for counts as text, once for all words that share them."""
        if (counts, budget) not in self.found:
            self.found[counts, budget] = list(self.search(_counts(counts), budget))
        return self.found[counts, budget]

    def near(self, counts: str, budget: int, word: str) -> Iterator[tuple[str, int]]:
        """Near words of ``word`` that are found from it; of equal counts, those that follow it."""
        for leaf, left in self.leaves(counts, budget):
            for held in leaf.near(word):
                if left < 2 or word < held[0]:
                    yield held


def _counts(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def _text(counts: tuple[int, ...]) -> str:
    return ",".join(map(str, counts))


def _levels(found: DataFrame, shard_words: int) -> tuple[int, DataFrame]:
    """The number of counts that name a shard, and ``(key, nb)``: the blocks of shards that even so are too large."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            tally = Counter(vector(w) for w in part["word"])
            yield pd.DataFrame({"v": [list(v) for v in tally], "n": list(tally.values())}, columns=["v", "n"])

    counted = cut(found.select("word").mapInPandas(vectors, "v array<long>, n long").groupBy("v").agg(F.sum("n").alias("n")))
    for level in range(1, GROUPS):  # a last count stays for the trie
        sizes = counted.groupBy(F.array_join(F.slice("v", 1, level), ",").alias("key")).agg(F.sum("n").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= shard_words:
            break
    return level, sizes.where(F.col("n") > shard_words).select("key", F.ceil(F.col("n") / shard_words).cast("int").alias("nb"))


def near_words(found: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n_near, form_n, form)`` for words of ``found`` (``word, n``) that have a near word; the form is the most
    frequent of these, of ties the smallest."""
    level, large = _levels(found, shard_words)
    large = cut(large)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[tuple[int, ...], tuple[list[str], list[int]]] = {}
        for part in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for word, n in zip(part["word"], part["n"]):
                counts = vector(word)
                first, rest = counts[:level], _text(counts[level:])
                if first not in asked:  # the word's own shard, then those that it asks in
                    asked[first] = [_text(first), *(_text(shard) for shard, _ in reach(first))], [-1, *(budget for _, budget in reach(first))]
                keys, budgets = asked[first]
                for column, values in zip(out, (keys, budgets, [rest] * len(keys), [word] * len(keys), [n] * len(keys))):
                    column.extend(values)
                if len(out[0]) > CHUNK:
                    yield pd.DataFrame(dict(zip(columns, out)))
                    out = ([], [], [], [], [])
            if out[0]:  # a frame of empty lists is one of floats, which Arrow does not take for strings
                yield pd.DataFrame(dict(zip(columns, out)))

    columns = ("key", "budget", "rest", "word", "n")
    rows = found.mapInPandas(deal, "key string, budget int, rest string, word string, n long")
    if not large.isEmpty():
        blocks = F.when(F.col("budget") < 0, F.array(F.pmod(F.xxhash64("word"), F.col("nb")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
        rows = rows.join(large, "key", "left").select("key", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(blocks)).alias("block"), "budget", "rest", "word", "n")
    else:
        rows = rows.withColumn("block", F.lit(0))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, at, seen = Trie(), None, {}

        def met(word: str, n: int, other: str) -> None:
            near, most, form = seen.get(word, (0, 0, ""))
            seen[word] = (near + 1, n, other) if (-n, other) < (-most, form) or not near else (near + 1, most, form)

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(w, *x) for w, x in seen.items()], columns=["word", "n_near", "form_n", "form"])
            seen.clear()
            return rows

        for part in batches:
            for key, block, budget, rest, word, n in zip(part["key"], part["block"], part["budget"], part["rest"], part["word"], part["n"]):
                if (key, block) != at:
                    trie, at = Trie(), (key, block)
                if budget < 0:
                    trie.add(_counts(rest), word, n)
                    continue
                for other, m in trie.near(rest, budget, word):
                    met(word, m, other)
                    met(other, n, word)
            if len(seen) > HELD:
                yield out()
        yield out()

    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, "key", "block").sortWithinPartitions("key", "block", "budget")
    pairs = dealt.select("key", "block", "budget", "rest", "word", "n").mapInPandas(search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    Null and empty texts have no words, repeated rows count each time, other columns are not read; an empty table gives
    no rows. A form is used ten times as often as its word, so forms end within the digits of the largest count.
    """
    found = cut(words(docs, id_col, text_col))
    near = near_words(found, shard_words)
    rows = found.join(near, "word", "left")
    is_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    hops = max(1, int(math.log(most, FORM_TIMES)) + 1)
    for _ in range((hops - 1).bit_length()):  # each round doubles the steps that a root is away
        roots = cut(roots)
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        roots = roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
