"""Packing by optimal length buckets.

A histogram of lengths over all documents, counted by a grouped aggregation, is all that reaches the driver, and its
size is bounded: lengths below 1,024 have bins of their own, longer ones 64 bins to an octave. Dynamic programming
over the bins picks the bucket boundaries with the least padding; inside a bucket, documents fill batches whose
padded size stays within the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Documents that one task numbers.
CHUNK_ROWS = 20_000
_FINE = 1024
_OCTAVE = 64


def word_count(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _bin(length: Column) -> Column:
    fine = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double") / _FINE) * _OCTAVE)
    return F.when(length < _FINE, length).otherwise(_FINE + fine.cast("long"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds (ascending) of at most ``buckets`` buckets with the least padding, and that padding.

    ``lengths`` are the bins' longest lengths, ascending. Of equal choices the one with fewer buckets, then the
    one whose last bucket begins first, is taken.
    """
    n = len(lengths)
    rows, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
    best = lengths * rows[1:] - total[1:]
    choice = [np.zeros(n, np.int64)]
    costs = [best]
    for _ in range(1, min(buckets, n)):
        now, pick = np.empty(n, np.int64), np.empty(n, np.int64)
        before = np.concatenate([[0], costs[-1]])
        for j in range(n):
            cost = before[: j + 1] + lengths[j] * (rows[j + 1] - rows[: j + 1]) - (total[j + 1] - total[: j + 1])
            pick[j] = int(np.argmin(cost))
            now[j] = cost[pick[j]]
        costs.append(now)
        choice.append(pick)
    k = int(np.argmin([c[-1] for c in costs]))
    least, ends, j = int(costs[k][-1]), [], n - 1
    while j >= 0:
        ends.append(int(lengths[j]))
        j = int(choice[k][j]) - 1 if k >= 0 else -1
        k -= 1
    return ends[::-1], least


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(id, n_tokens, bucket_len, padding, batch_id, slot)`` for every row of ``docs``.

    ``length`` counts a document's tokens (default: words of ``text``; null counts as 0). A batch holds
    floor(budget / bucket_len) documents of one bucket, one at least, so a document longer than the budget is a
    batch alone. Batches are numbered without gaps over all buckets; ids order documents within a bucket's chunk.
    Repeated rows and rows without an id get slots of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(word_count(F.col("text")) if length is None else length.cast("long"), F.lit(0)).alias("n"))
    found = rows.groupBy(_bin(F.col("n")).alias("bin")).agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum")).orderBy("bin").collect()
    if not found:
        return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("padding"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"))
    tops, counts, sums = (np.array([r[c] for r in found], dtype=np.int64) for c in ("top", "rows", "sum"))
    ends, _ = boundaries(tops, counts, sums, buckets)
    held = [int(counts[(tops > low) & (tops <= high)].sum()) for low, high in zip([-1, *ends], ends)]
    fits = [max(1, budget // max(1, e)) for e in ends]
    base = np.concatenate([[0], np.cumsum([-(-h // f) for h, f in zip(held, fits)])])
    chunks = 1 + int(counts.sum()) // chunk_rows
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("b"))
    bucket = F.lit(len(ends))
    for k in range(len(ends) - 1, 0, -1):
        bucket = F.when(F.col("n") <= ends[k - 1], k).otherwise(bucket)
    rows = rows.withColumn("b", bucket).withColumn("c", F.pmod(F.xxhash64("id", "n"), F.lit(chunks)))
    sizes = rows.groupBy("b", "c").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("b", "c", before.alias("before"))
    rows = rows.join(sizes, ["b", "c"])
    seat = F.col("before") + F.row_number().over(Window.partitionBy("b", "c").orderBy("id", "n")) - 1
    rows = rows.withColumn("seat", seat).withColumn("len", pick(ends)).withColumn("fit", pick(fits)).withColumn("base", pick(base[:-1]))
    batch = F.col("base") + F.floor(F.col("seat") / F.col("fit"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("len").alias("bucket_len"), (F.col("len") - F.col("n")).alias("padding"), batch.cast("long").alias("batch_id"), F.pmod("seat", "fit").cast("long").alias("slot"))
