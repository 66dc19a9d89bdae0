"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has next to no resemblance to the whole document, so items are partitioned by
their number of five-word shingles (powers of two), and each partition is searched in windows of its own size: a
window spans 2.5 times the partition's lower bound and starts every half of it, so that any run as long as an item
of the partition lies whole in some window. An item of which 80 % stands in a window resembles it by 0.29 at
least, and is missed by all of 32 one-row MinHash bands with a chance below 2e-5. Window minima come from
block minima, which the partitions share by pairwise minima; a partition costs half of the one below it.
An item of fewer than five words is its own only shingle, looked up among all runs of so many words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 32
#: Items and bytes of their texts searched at once: what one index holds. More are searched in blocks of about so many.
ITEM_BLOCK = 20_000
ITEM_BYTES = 32 << 20
_CACHE_WORDS = 300_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_XOR, _ODD = (_RNG.integers(0, 2**63, 256, dtype=np.uint64) for _ in range(2))
_ODD = _ODD * np.uint64(2) + np.uint64(1)
_BITS = 16


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, every other ASCII character but letters and digits is a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingles(tokens: list[bytes], width: int = SHINGLE_WORDS) -> set[bytes]:
    return {b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def own_shingles(tokens: list[bytes], width: int) -> set[bytes]:
    """An item's shingles: the whole of it where it has fewer words, none where it has no word."""
    return shingles(tokens, min(width, max(1, len(tokens))))


class _Hasher:
    """Hashes of all shingles of a list of words, by vector arithmetic over the words' hashes."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.digest, self.known = width, xxhash.xxh64_intdigest, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        try:
            each = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(self.known) > _CACHE_WORDS:
                self.known = {}
            self.known.update((w, self.digest(w)) for w in tokens if w not in self.known)
            each = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        n = max(0, len(tokens) - self.width + 1)
        h = np.zeros(n, np.uint64)
        for k in range(self.width):
            h *= _STEP
            h += each[k : k + n]
        h ^= h >> np.uint64(29)
        h *= _STEP
        return h ^ (h >> np.uint64(32))


class _Index:
    """Signatures of items by size partition; small enough to send to every task, see ITEM_BLOCK and ITEM_BYTES.

    Items are known by their place in the list, as several texts may share an id.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, bands: int):
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        self.sets = [own_shingles(w, width) for w in tokens]
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        levels, hasher = defaultdict(list), _Hasher(width)
        for k, w in enumerate(tokens):
            if 0 < len(w) < width:
                self.short[len(w)][b" ".join(w)].append(k)
            elif w:
                h = hasher(w)
                levels[int(len(h)).bit_length() - 1].append((k, h))
        self.short = {n: dict(found) for n, found in self.short.items()}
        self.levels = {}
        for level, held in sorted(levels.items()):
            self.levels[level] = []
            for k in range(bands):
                where = defaultdict(list)
                for i, h in held:
                    where[int(((h ^ _XOR[k]) * _ODD[k]).min())].append(i)
                seen = np.zeros(1 << _BITS, bool)
                seen[np.array(list(where), dtype=np.uint64) >> np.uint64(64 - _BITS)] = True
                self.levels[level].append((seen, dict(where)))

    def candidates(self, hashes: np.ndarray, bands: int) -> list[tuple[int, int]]:
        """``(position, item)`` where a window that starts at about this shingle shares a minimum with an item."""
        if not self.levels or not len(hashes):
            return []
        low, out = min(self.levels), []
        size = max(1, 1 << max(0, low - 1))
        edges = np.arange(0, len(hashes), size)
        for k in range(bands):
            block, step = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], edges), size
            for level in range(low, max(self.levels) + 1):
                want = max(1, 1 << max(0, level - 1))
                while step < want:
                    block = np.minimum.reduceat(block, np.arange(0, len(block), 2))
                    step *= 2
                if level in self.levels:
                    seen, where = self.levels[level][k]
                    window = block.copy()
                    for lag in range(1, 5):
                        if lag < len(block):
                            np.minimum(window[:-lag], block[lag:], out=window[:-lag])
                    for at in np.flatnonzero(seen[window >> np.uint64(64 - _BITS)]):
                        out.extend((int(at) * step, i) for i in where.get(int(window[at]), ()))
        return out


def _search(docs: DataFrame, items: list[tuple[int, str]], width: int, threshold: float, bands: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(_Index(items, width, bands))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, hasher = index.value, _Hasher(width)
        for part in batches:
            out, ids, texts = [], part["id"].to_numpy(), part["t"].to_numpy()
            for at in range(0, len(ids), 256):
                tokens = [words(t) for t in texts[at : at + 256]]
                hashes = [hasher(w) for w in tokens]
                first = np.cumsum([0, *map(len, hashes)])
                pairs, step = set(), 4 << max(found.levels, default=0)
                for position, item in found.candidates(np.concatenate(hashes), bands):
                    # a window may begin in one document and end in the next ones
                    a, b = np.searchsorted(first, [position, position + step], side="right") - 1
                    pairs.update((d, item) for d in range(a, min(b, len(tokens) - 1) + 1))
                sets: dict[int, set[bytes]] = {}
                for d, item in sorted(pairs):
                    if d not in sets:
                        sets[d] = shingles(tokens[d], width)
                    shared, whole = len(found.sets[item] & sets[d]), len(found.sets[item])
                    if shared >= threshold * whole:
                        out.append((ids[at + d], found.ids[item], shared, whole))
                for size, short in found.short.items():
                    for d, own in enumerate(tokens):
                        for held in shingles(own, size) & short.keys():
                            out.extend((ids[at + d], found.ids[k], 1, 1) for k in short[held])
            yield pd.DataFrame(out, columns=["id", "item", "shared", "whole"]).astype({"id": "Int64"})

    return docs.mapInPandas(run, "id long, item long, shared long, whole long")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = SHINGLE_WORDS, threshold: float = THRESHOLD, bands: int = BANDS, item_block: int = ITEM_BLOCK, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, item_id, shared, item_shingles, containment)`` for every item of which a document holds
    ``threshold`` or more of the distinct shingles.

    Items and their bytes are counted first; more than ``item_block`` of them, or than ``item_bytes``, are searched
    block by block, so that what is sent to the tasks stays bounded. An item of fewer than ``width`` words is one
    shingle, its whole sequence; an item without words matches nothing. Null texts are empty. Rows without an id are
    left out. Each row is compared by itself: of several rows with the same two ids the result is the one of the
    largest containment, then of the most shared shingles. String ids must be numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id IS NOT NULL")
    asked = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    blocks = max(1, -(-size.n // item_block), -(-(size.bytes or 0) // item_bytes))
    found = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        found.append(_search(rows, [(r.i, r.t) for r in held], width, threshold, bands))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct((F.col("shared") / F.col("whole")).alias("containment"), "shared", "whole")).alias("best")
    out = out.groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.shared", F.col("best.whole").alias("item_shingles"), "best.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay."""
    hits = find(docs, items, id_col, text_col, **kw).select(id_col).distinct()
    return docs.join(hits, id_col, "left_anti")


#: The same result by plain comparison of all shingles.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-@\\[-`{-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-@\\[-`{-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
dr AS (SELECT row_number() OVER () AS d, doc_id, w FROM (SELECT DISTINCT doc_id, w FROM d WHERE doc_id IS NOT NULL)),
br AS (SELECT row_number() OVER () AS b, item_id, w, least(5, len(w)) AS k FROM (SELECT DISTINCT item_id, w FROM b WHERE item_id IS NOT NULL AND len(w) > 0)),
ds AS (SELECT DISTINCT d, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM dr, (SELECT DISTINCT k FROM br)),
bs AS (SELECT DISTINCT b, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM br),
n AS (SELECT b, count(*) AS whole FROM bs GROUP BY b),
m AS (SELECT d, b, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY d, b),
r AS (SELECT doc_id, item_id, max({'c': shared / whole, 's': shared, 'w': whole}) AS x FROM m JOIN n USING (b) JOIN dr USING (d) JOIN br USING (b) WHERE shared >= 0.8 * whole GROUP BY doc_id, item_id)
SELECT doc_id, item_id, x.s AS shared, x.w AS item_shingles, x.c AS containment FROM r
"""
