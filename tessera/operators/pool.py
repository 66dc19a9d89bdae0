"""Aggregations over token tables and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("sample_id").agg(F.sum("mask").cast("long").alias("length"))


def pair_pooling(rows: DataFrame, key: str = "item") -> DataFrame:
    """``(key, pair, dim, value)``: the mean of rows 2i and 2i + 1; an odd last row drops (A2).

    Vectors are shuffled whole and exploded after their mean is taken.
    """
    vec = F.transform("vec", lambda x: x.cast("double"))
    pairs = rows.groupBy(key, F.floor(F.col("pos") / 2.0).cast("long").alias("pair")).agg(F.collect_list(vec).alias("v")).where(F.size("v") == 2)
    means = F.zip_with(F.col("v")[0], F.col("v")[1], lambda x, y: (x + y) / 2)
    return pairs.select(key, "pair", F.posexplode(means).alias("dim", "value")).select(key, "pair", F.col("dim").cast("long").alias("dim"), "value").where("value IS NOT NULL")


def stats_pooling(rows: DataFrame, key: str = "item", softmax_of: Column | None = None) -> DataFrame:
    """``(key, dim, mean, std)`` per channel, weighted uniformly or by the softmax of a score per row (A3).

    Channels are summed in each task before the shuffle, so a key that holds most rows costs one row a channel and task.
    """
    channel = F.posexplode(F.transform("vec", lambda x: x.cast("double"))).alias("dim", "x")
    dim = F.col("dim").cast("long").alias("dim")
    clamped = lambda v: F.sqrt(F.greatest(v, F.lit(1e-12))).alias("std")
    if softmax_of is None:
        return rows.select(key, channel).groupBy(key, dim).agg(F.avg("x").alias("mean"), clamped(F.var_pop("x")))
    scored = rows.select(key, F.transform("vec", lambda x: x.cast("double")).alias("vec"), softmax_of.cast("double").alias("s"))
    # the vector of the largest weight is taken off before squares are summed, so these do not cancel
    best = scored.groupBy(key).agg(F.max("s").alias("top"), F.max_by("vec", "s").alias("base"))
    own = scored.join(best, key).select(key, F.exp(F.col("s") - F.col("top")).alias("w"), F.posexplode(F.arrays_zip("vec", "base")).alias("dim", "z"))
    x = F.col("z.vec") - F.col("z.base")
    sums = own.groupBy(key, dim).agg(F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("a"), F.sum(F.col("w") * x * x).alias("b"), F.first("z.base").alias("base"))
    shift = F.col("a") / F.col("w")
    return sums.select(key, "dim", (F.col("base") + shift).alias("mean"), clamped(F.col("b") / F.col("w") - shift * shift))


def masked_nll(rows: DataFrame, key: str = "item") -> DataFrame:
    """Mean negative log-likelihood of next labels over rows whose next row is unmasked; labels below 0 are ignored.

    ``rows``: ``key, pos, label, mask, logits``. One number over all tokens.
    """
    w = Window.partitionBy(key).orderBy("pos")
    shifted = rows.withColumn("next", F.lead("label").over(w)).withColumn("next_mask", F.lead("mask").over(w)).where("next_mask = 1 AND next >= 0")
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    loss = F.log(total) + top - F.element_at("logits", (F.col("next") + 1).cast("int")).cast("double")
    return shifted.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def padding_plan(chunks: DataFrame, batch: str = "audio_id", length: str = "len") -> DataFrame:
    """Per batch its widest chunk, its masks' sums before and after stride 2, and the padded share."""
    rows = chunks.groupBy(batch).agg(F.max(length).alias("width"), F.count(F.lit(1)).alias("chunks"), F.sum(length).alias("kept"), F.sum(F.floor((F.col(length) - 1) / 2.0) + 1).cast("long").alias("kept_half"))
    return rows.withColumn("waste", 1 - F.col("kept") / (F.col("chunks") * F.col("width")))


def pad_right(values: Column, width: Column, fill: float = 0.0) -> Column:
    """``values`` filled up on the right to ``width``."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))))
