"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

The kept share is the same for every text, so sketches of texts of any length compare, and the sketch of a union is
the union of the sketches. Shingles are ``WIDTH`` code points of the lower-cased text (a shorter text is one
shingle). A sketch is written as its sorted 40-bit values, ten hex digits each; that of an empty text is the empty string.
A text of which the threshold keeps nothing has its smallest whole hash, which is above the threshold and so known as
such, written as ``~`` and 16 hex digits: different short texts stay different.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 8
#: The kept fraction is 2 ** -FRACTION_BITS.
FRACTION_BITS = 4
_FACTOR, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FIRST = -(2**63)


def sketch(text: str, width: int = WIDTH, fraction_bits: int = FRACTION_BITS) -> np.ndarray:
    """Sorted distinct 40-bit values of the kept shingles, or else the smallest hash of a text that keeps none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(codes):
        return codes
    n = max(1, len(codes) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(codes))):
        h *= _FACTOR
        h += codes[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(30)
    h *= _MIX_A
    h ^= h >> np.uint64(27)
    h *= _MIX_B
    h ^= h >> np.uint64(31)
    kept = h[h >> np.uint64(64 - fraction_bits) == 0]
    if not len(kept):
        return h.min(keepdims=True)
    return np.unique((kept >> np.uint64(24 - fraction_bits)) & np.uint64((1 << 40) - 1))


def to_text(values: np.ndarray) -> str:
    if len(values) == 1 and values[0] >> np.uint64(40):
        return f"~{int(values[0]):016x}"
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def from_text(sketched: str) -> np.ndarray:
    if sketched.startswith("~"):
        return np.array([int(sketched[1:], 16)], dtype=np.uint64)
    raw = np.frombuffer(bytes.fromhex(sketched), np.uint8).reshape(-1, 5)
    return np.hstack([np.zeros((len(raw), 3), np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def merge(*sketches: str) -> str:
    """The sketch of texts taken together."""
    values = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(from_text, sketches)]))
    kept = values[values >> np.uint64(40) == 0]
    return to_text(kept if len(kept) else values[:1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller text's shingles that the other text has; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _chunk(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, by a search in two steps: whole blocks, then one of them."""
    size = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    below = lambda listed: F.size(F.filter(listed, lambda b: b < F.col("key")))
    whole = below(F.from_json(F.lit(json.dumps([b[-1] for b in blocks])), "array<bigint>"))
    held = F.try_element_at(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), whole + 1)
    return F.least(whole * size + F.coalesce(below(held), F.lit(0)), F.lit(len(bounds)))  # the last block may be shorter


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in chunks of the id order, each chunk followed by a copy (``carry`` 1) of the first row of the next one.

    Only the chunks' smallest ids, one small row per chunk, are shared; the last chunk is followed by the first.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * width
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(_FIRST)))
    bounds = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] or []
    rows = rows.withColumn("chunk", _chunk(sorted({int(b) for b in bounds})))
    firsts = rows.groupBy("chunk").agg(F.min("key").alias("first"))
    order = Window.orderBy("chunk")
    last = F.max("chunk").over(Window.partitionBy())
    firsts = firsts.select("chunk", "first", F.coalesce(F.lag("chunk").over(order), last).alias("before"))
    own = F.struct(F.col("chunk").alias("c"), F.lit(0).alias("carry"))
    copy = F.struct(F.col("before").alias("c"), F.lit(1).alias("carry"))
    rows = rows.join(F.broadcast(firsts), "chunk")  # at most 4 rows per shuffle partition
    rows = rows.withColumn("x", F.explode(F.when(F.col("key") == F.col("first"), F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select(F.col("x.c").alias("chunk"), F.col("x.carry").alias("carry"), "key", "id", "t")
    return rows.repartition(width, "chunk").sortWithinPartitions("chunk", "carry", "key", "t")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Per document its sketch, that of its edited text (see :func:`edited`) and how alike they and the next one's are.

    ``compared_edited`` and ``compared_next`` are the hashes of the smaller sketch of each comparison. One alone says
    whether short texts are equal, not whether one holds the other; a likeness of 0 is then no evidence against it.

    The next document is the next row in ascending id order, rows that share an id by their text, the first after
    the last; a table of one row is its own next. Null texts are empty. Rows without an id come first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chunk = None, None
        for part in batches:
            out = []
            for c, carry, i, t in part[["chunk", "carry", "id", "t"]].itertuples(index=False, name=None):
                new = (i, t, sketch(t, width, fraction_bits))
                if held is not None and c == chunk:
                    i0, t0, s0 = held
                    text = edited(t0, t)
                    s1 = sketch(text, width, fraction_bits)
                    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i0, len(t0), digest, to_text(s0), to_text(s1), likeness(s0, s1), likeness(s0, new[2]), min(len(s0), len(s1)), min(len(s0), len(new[2]))))
                held, chunk = (None if carry else new), c
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "compared_edited", "compared_next"]).astype({"id": "Int64", "n_chars": "int64"})

    shape = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, compared_edited long, compared_next long"
    return _dealt(docs, id_col, text_col).mapInPandas(run, shape).withColumnRenamed("id", id_col)
