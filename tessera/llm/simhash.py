"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Bit position i is given a code word m(i) of r + 1 bits; for every non-zero v of
r + 1 bits, table v keeps the positions whose <m(i), v> is odd. Two fingerprints that differ in at most r
positions span at most an r-dimensional space of code words, so some v is orthogonal to all of them and its
mask hides every differing position: the pair collides in that table. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.plans.session import cut

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Where links are verified on the texts afterwards: fingerprints of a document, each with its own covering tables,
#: and the bits in which a colliding pair may differ. Fourteen find nine in ten pairs at a similarity of 0.8.
SEGMENTS, ACCEPT = 14, 14
#: Rows of a bucket that one task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Ids (8 bytes each) up to which a list of documents is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words of the shingles on which links are verified, and bits in which the sketches of a link may differ: more than
#: three standard deviations beyond what a similarity of 0.8 gives in short texts, six in long ones.
VERIFY_WORDS, SKETCH_BITS = 5, 22
_SLICE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, segments: int = 1) -> list[int]:
    """SimHash segments of 64 bits; A-Z is lowered, ASCII white space splits words, repeated shingles count each time.

    The first segment is over the shingles' XXH64, further ones over multiplicative mixes of it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * segments
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        spans = list(zip(starts.tolist(), ends[width - 1 :].tolist()))
    ones = np.zeros((segments, 64), np.int64)
    for at in range(0, len(spans), _SLICE):
        hashes = np.array([digest(joined[p:q], SEED) for p, q in spans[at : at + _SLICE]], dtype="<u8")
        for k in range(segments):
            if k:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
                hashes ^= hashes >> np.uint64(29)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += np.add.reduce(bits, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(spans), axis=1, bitorder="little").view("<u8").ravel().tolist()


def sketch(text: str | None) -> int:
    """64 bits over the set of shingles of ``VERIFY_WORDS`` words: a bit of the smallest hash in each of 64 ranges, of the
    next range that has one where a range has none.

    Texts that share 0.8 of their shingles differ in about six bits, others in about thirty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    grams = {b" ".join(words[i : i + VERIFY_WORDS]) for i in range(max(1, len(words) - VERIFY_WORDS + 1))}
    hashes = np.unique(np.fromiter(map(digest, grams), np.uint64, len(grams)))
    ranges = hashes >> np.uint64(58)
    least = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    held, each = ranges[least].astype(np.int64), np.arange(64)
    at = np.searchsorted(held, each) % len(held)
    bits = ((hashes[least][at] + ((held[at] - each) % 64).astype(np.uint64)) * _MIX) >> np.uint64(63)
    return int(np.bitwise_or.reduce(bits << each.astype(np.uint64)))


def _digest(text: str | None) -> bytes:
    """A hash of all the words of a text, lowered and split as for :func:`fingerprint`."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 1, whole: bool = False) -> DataFrame:
    """``(id, fp)``, or ``(id, fp0, fp1, ..)``, as signed longs; a null text counts as empty and gives zeros.

    With ``whole`` a further column of that name holds a hash of the whole text, up to case and white space, and
    ``sk`` its sketch.
    """
    names = ["fp"] if segments == 1 else [f"fp{k}" for k in range(segments)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            values = np.array([fingerprint(t, segments=segments) for t in part["t"]], dtype=np.uint64).reshape(-1, segments)
            own = {"whole": [_digest(t) for t in part["t"]], "sk": np.array([sketch(t) for t in part["t"]], np.uint64).view(np.int64)} if whole else {}
            yield pd.DataFrame({"id": part["id"]} | {n: values[:, k].view(np.int64) for k, n in enumerate(names)} | own)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, ", ".join(["id long", *(f"{n} long" for n in names), *["whole binary", "sk long"] * whole]))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 covering masks as signed longs; code words are dealt in turn, so masks weigh about alike."""
    words = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    found = [sum(1 << i for i, w in enumerate(words) if (w & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in found]


def _forest(fps: np.ndarray, nodes: np.ndarray, split: int, radius: int, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what lies within the radius and alike in sketch, as a spanning forest: never more links than nodes.

    With ``split``, only pairs of one of the first ``split`` rows and one of the rest count.
    """
    label, out = np.arange(len(nodes)), []
    for i in range(split or len(nodes)):
        at = split or i + 1
        near = np.flatnonzero((np.bitwise_count(fps[at:] ^ fps[i]) <= radius) & (np.bitwise_count(sketches[at:] ^ sketches[i]) <= SKETCH_BITS)) + at
        near = near[label[near] != label[i]]
        for other, j in zip(*np.unique(label[near], return_index=True)):
            label[label == other] = label[i]
            out.append((int(nodes[i]), int(nodes[near[j]])))
    return out


def _pairs(fps: np.ndarray, nodes: np.ndarray, labels: np.ndarray, split: int, radius: int, sketches: np.ndarray, earlier: list[np.uint64]) -> Iterator[np.ndarray]:
    """Rows ``(src, dst)`` of all pairs within the radius, alike in sketch, whose labels differ and which do not meet
    under one of the ``earlier`` masks; ``split`` as in :func:`_forest`."""
    for i in range(split or len(nodes)):
        at = split or i + 1
        apart = fps[at:] ^ fps[i]
        near = np.flatnonzero((np.bitwise_count(apart) <= radius) & (labels[at:] != labels[i]) & (np.bitwise_count(sketches[at:] ^ sketches[i]) <= SKETCH_BITS))
        for mask in earlier:
            near = near[(apart[near] & mask) != 0]
        near = near + at
        if len(near):
            ends = nodes[near]
            yield np.stack([np.minimum(ends, nodes[i]), np.maximum(ends, nodes[i])], axis=1)


def buckets(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, fp, .., v, key)`` of all rows of ``fps`` (``node, fp, seg``) that share a covering table's bucket with another.

    Nodes are distinct in a segment. Of all rows by tables, which go through one shuffle, few share a bucket; other columns
    of ``fps`` go with them.
    """
    covering = masks(radius)
    mask = F.element_at(F.array(*[F.lit(m) for m in covering]), F.pmod(F.col("v"), F.lit(len(covering))) + 1)
    key, more = F.col("fp").bitwiseAND(mask), [c for c in fps.columns if c not in ("node", "fp", "seg")]
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the shuffle carries no key
    tables = F.transform(F.sequence(F.lit(0), F.lit(len(covering) - 1)), lambda k: (F.col("seg") * len(covering) + k).cast("int"))
    rows = fps.select("node", "fp", *more, F.explode(tables).alias("v"))
    rows = rows.repartition(width, F.col("v"), key).select("node", "fp", *more, "v", key.alias("key"))
    bucket = Window.partitionBy("v", "key").orderBy("node")
    rows = rows.select("*", F.lag("node").over(bucket).alias("before"), F.lead("node").over(bucket).alias("next"))
    return rows.where("before IS NOT NULL OR next IS NOT NULL").drop("before", "next")


def links(fps: DataFrame, radius: int = RADIUS, accept: int | None = None, block: int = BLOCK, every: bool = False) -> DataFrame:
    """``(src, dst)`` links between ``node``s that join all whose ``fp`` (of one segment ``seg``) differ in ``radius`` bits:
    :func:`compared` over the :func:`buckets`."""
    return compared(cut(buckets(fps, radius)), radius, accept, block, every)


def compared(rows: DataFrame, radius: int = RADIUS, accept: int | None = None, block: int = BLOCK, every: bool = False) -> DataFrame:
    """``(src, dst)`` links between nodes of one bucket of ``rows``, a written table of :func:`buckets`.

    With ``accept`` over ``radius``, colliding pairs of up to ``accept`` bits are linked too. A bucket over ``block``
    rows is cut into blocks and each pair of blocks is a group of its own, so no task holds more than two blocks; a
    group returns a spanning forest. With ``every``, a group returns not a forest but all its pairs whose ``label`` (a
    column of ``rows`` then) differs, each pair in the first table of a segment in which it meets. Where ``rows`` have
    sketches ``sk``, pairs that differ by more than ``SKETCH_BITS`` of them are left out.
    """
    accept = radius if accept is None else accept
    covering, label = masks(radius), "label" if every else "node"
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = ["sk"] if "sk" in rows.columns else []
    rows = rows.select("node", "fp", *extra, F.col(label).alias("c"), "v", "key")
    full = rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").drop("low", "high")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = rows.join(full, ["v", "key"]).withColumn("nb", blocks).withColumn("me", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, F.col("me")).alias("i"), F.greatest(k, F.col("me")).alias("j"))))
    dealt = dealt.select("node", "fp", *extra, "c", "v", "key", "me", pairs.alias("p")).select("node", "fp", *extra, "c", "v", "key", "me", "p.i", "p.j")
    hidden = [np.uint64(m % 2**64) for m in covering]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, found = None, [], []

        def close() -> Iterator[pd.DataFrame]:
            if held is not None:
                got = np.concatenate(own)
                values, split = np.ascontiguousarray(got[:, 1]).view(np.uint64), 0 if held[2] == held[3] else int((got[:, 5] == held[2]).sum())
                sketches = np.ascontiguousarray(got[:, 6]).view(np.uint64) if extra else np.zeros(len(got), np.uint64)
                if every:
                    for part in _pairs(values, got[:, 0], got[:, 2], split, accept, sketches, hidden[: held[0] % len(hidden)]):
                        yield pd.DataFrame(part, columns=["src", "dst"])
                else:
                    found.extend(_forest(values, got[:, 0], split, accept, sketches))

        def out() -> pd.DataFrame:
            links = pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["src", "dst"])
            found.clear()
            return links

        for part in batches:
            rows = part[["node", "fp", "c", "v", "key", "me", *(extra or ["me"]), "i", "j"]].to_numpy(dtype=np.int64)
            cuts = (np.flatnonzero(np.any(rows[1:, [3, 4, 7, 8]] != rows[:-1, [3, 4, 7, 8]], axis=1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if b > a:
                    key = tuple(rows[a, [3, 4, 7, 8]].tolist())
                    if key != held:
                        yield from close()
                        held, own = key, []
                    own.append(np.ascontiguousarray(rows[a:b, :7]))
            yield out()
        yield from close()
        yield out()

    groups = dealt.repartition(width, "v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j", F.col("me") != F.col("i"), "node")
    return groups.mapInPandas(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that can be reached over links of at most ``radius`` differing bits.
    Null texts count as empty; empty texts have fingerprint zero and link like any other. Repeated rows stay.
    Rows without an id keep their place but never name a component.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    comp = connected_components(links(reps.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("seg")), radius))
    named = reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    first = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    full = named.join(first, "c").select("fp", "component_id")
    return fps.join(full, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if it is counted and small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _similar(docs: DataFrame, edges: DataFrame, similarity: float, width: int) -> DataFrame:
    """The ``edges`` between ids of ``docs`` (``id, t``) whose texts share ``similarity`` of their word shingles."""
    asked = cut(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for part in batches:
            out = []
            for text in part["t"]:
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                grams = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
                out.append(np.array([digest(g) for g in grams], dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"id": part["id"], "s": out})

    texts = docs.join(_few(asked), "id").groupBy("id").agg(F.min("t").alias("t"))
    held = cut(texts.mapInPandas(sets, "id long, s array<long>"))
    both = edges.join(held.select(F.col("id").alias("src"), F.col("s").alias("a")), "src").join(held.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("src", "dst")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, accept: int = ACCEPT, similarity: float = 0.8, verify_words: int = VERIFY_WORDS) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates: that with the smallest id.

    Candidates collide in a covering table of one of ``segments`` fingerprints and differ there in ``accept`` bits at
    most, and their sketches in ``SKETCH_BITS``; a link stands where the texts share ``similarity`` of their ``verify_words``-word shingles. Links are taken
    first from spanning forests of candidates; then all candidates that are still apart are verified. Only texts
    that are equal up to case and white space are joined without that. Rows without an id are kept as they are, and so
    are rows that share an id and differ in text; of rows that repeat id and text, one stays. An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id IS NOT NULL")
    names = [f"fp{k}" for k in range(segments)]
    fps = fingerprints(rows, "id", "t", segments, whole=True).groupBy("id").agg(F.min(F.struct(*names, "whole", "sk")).alias("f"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    fps = cut(fps.where("low = high").select("id", "f.*"))
    reps = cut(fps.groupBy("whole", *names).agg(F.min("id").alias("node"), F.min("sk").alias("sk")))
    segs = reps.select("node", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), F.col(n).alias("fp")) for k, n in enumerate(names)])).alias("x"))
    # all tables are met once; sketches join what shares a bucket
    held = cut(buckets(segs.select("node", "x.seg", "x.fp")).join(reps.select("node", "sk"), "node"))
    near = cut(compared(held, RADIUS, accept))
    sure = cut(_similar(rows, near, similarity, verify_words))
    # a forest's edge that fails leaves pairs behind it unseen: all colliding pairs of different components follow
    joined = connected_components(sure)
    open_ = held.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    rest = cut(compared(open_, RADIUS, accept, every=True).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    comp = connected_components(sure.unionByName(_similar(rows, rest, similarity, verify_words))).where("node <> component")
    kept = reps.join(comp, "node", "left_anti").select(F.col("node").alias("id"))
    drop = cut(fps.select("id").join(kept, "id", "left_anti").select(F.col("id").alias(id_col)))
    again = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(id_col)))  # the only rows that move
    stay = docs.join(_few(drop), id_col, "left_anti")
    single = stay.join(_few(again), id_col, "left_anti")
    return single.select(docs.columns).unionByName(stay.join(_few(again), id_col, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns))
