"""Three-axis positions from raw token rows: ids and masks, grids of images and videos, lengths of audios.

Unpadded rows fall into islands of media and of everything else. The k-th island of a medium takes the k-th grid or
length of its sample. What a sequential reader carries along is the start of each island, and the step from one start to
the next depends on the island alone, even where it is not the island's largest position: so starts are a prefix sum.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators.layout import _before, _upto, positions_text, time_chunks
from tessera.plans.session import cut

#: Names of the special ids that the parse reads.
IDS = {"vision_start": 90001, "audio_start": 90006, "image": 90003, "video": 90004, "audio": 90005}
CLOCK, SECONDS_PER_CHUNK = 25, 2.0
#: Rows that one task sorts, for windows over samples and for joins of them. A sample is not cut.
TASK_ROWS = 1 << 19


def _island_rows(tokens: DataFrame, ids: Mapping[str, int], in_video: bool) -> DataFrame:
    """Rows of ``tokens`` (unpadded) with ``i`` (place among them), ``kind`` and ``island``; with ``in_video``, audio and video rows that
    stand together are one island, which its first row names."""
    w = Window.partitionBy("sample_id").orderBy("pos")
    kind = F.lit("text")
    for name in ("image", "video", "audio"):
        kind = F.when(F.col("token_id") == ids[name], name).otherwise(kind)
    rows = tokens.select("sample_id", "pos", "token_id", kind.alias("kind"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    both = F.when(F.col("kind").isin("video", "audio"), "av").otherwise(F.col("kind")) if in_video else F.col("kind")
    before = F.lag("both").over(w)
    rows = rows.withColumn("both", both).withColumn("turn", F.when(before.isNull() | (before != F.col("both")), 1).otherwise(0))
    return rows.select("sample_id", "pos", "token_id", "kind", "i", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("island"))


def _islands(rows: DataFrame, ids: Mapping[str, int], in_video: bool) -> DataFrame:
    """One row per island: ``kind, first, n``, its last id, and ``k``, its number among its sample's media of a kind."""
    found = rows.groupBy("sample_id", "island").agg(
        F.min_by("kind", "i").alias("kind"), F.min("i").alias("first"), F.count(F.lit(1)).alias("n"), F.max_by("token_id", "i").alias("last_id"), F.count_distinct("kind").alias("kinds"),
    )
    w = Window.partitionBy("sample_id").orderBy("island")
    # a video whose island holds audio, or which the paired starts announce, is read with its audio
    av = (F.col("kind") == "video") & F.lit(in_video)
    found = found.withColumn("kind", F.when(av, "av").otherwise(F.col("kind")))
    count = lambda *kinds: (F.sum(F.col("kind").isin(*kinds).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    k = F.when(F.col("kind") == "image", count("image")).when(F.col("kind").isin("video", "av"), count("video", "av"))
    found = found.withColumn("k", k).withColumn("audio_k", F.when(F.col("kind").isin("audio", "av"), count("audio", "av")))
    return found.withColumn("started", F.lag("last_id").over(w) == F.when(F.col("kind").isin("audio", "av"), ids["audio_start"]).otherwise(ids["vision_start"]))


def _t(step: Column, sec: Column, clock: int) -> Column:
    """A grid step on the clock, cut off; in single precision, as positions are defined."""
    return (step.cast("float") * sec.cast("float") * F.lit(float(clock)).cast("float")).cast("long")


def _measured(islands: DataFrame, grids: DataFrame, audios: DataFrame, clock: int, merge: int) -> DataFrame:
    """Islands with the grids and lengths that they take, and ``error`` where these and the rows disagree."""
    grid = grids.select("sample_id", F.when(F.col("modality") == "image", "image").otherwise("video").alias("grid_kind"), F.col("k").alias("grid_k"), "grid_t", F.floor(F.col("grid_h") / float(merge)).cast("long").alias("gh"), F.floor(F.col("grid_w") / float(merge)).cast("long").alias("gw"), F.when(F.col("modality") == "image", 1.0).otherwise(F.col("sec")).alias("sec"))
    heard = audios.select("sample_id", F.col("k").alias("audio_k"), E.audio_lengths(F.col("mel_len"))["tokens"].alias("heard"))
    rows = islands.withColumn("grid_kind", F.when(F.col("kind") == "av", "video").otherwise(F.col("kind"))).withColumnRenamed("k", "grid_k")
    rows = rows.join(grid, ["sample_id", "grid_kind", "grid_k"], "left").join(heard, ["sample_id", "audio_k"], "left")
    cells = F.col("grid_t") * F.col("gh") * F.col("gw")
    want = F.when(F.col("kind").isin("image", "video"), cells).when(F.col("kind") == "audio", F.col("heard")).when(F.col("kind") == "av", cells + F.col("heard")).otherwise(F.col("n"))
    error = F.when(want.isNull(), "grid_missing").when(want != F.col("n"), "grid_len_mismatch").when((F.col("kind") != "text") & ~F.coalesce("started", F.lit(False)), "start_missing")
    last = F.greatest(_t(F.col("grid_t") - 1, F.col("sec"), clock), F.col("gh") - 1, F.col("gw") - 1)
    return rows.withColumn("error", error).withColumn("span", F.when(F.col("kind").isin("image", "video"), last + 1).otherwise(F.col("n")))


def _interleaved(av: DataFrame, clock: int, width: int) -> DataFrame:
    """Rows of videos with their audio, chunk by chunk, video first: ``(key, o, rt, rh, rw)`` from the island's start,
    ``step`` to the next start (one past the last part that is not empty) and ``top``, the largest position."""
    key = F.struct("sample_id", "island").alias("key")
    plane = F.col("gh") * F.col("gw")
    cells = av.select(key, "gh", "gw", "sec", plane.alias("plane"), F.explode(_upto(F.col("grid_t") * plane)).alias("i"))
    cell = F.col("i") % F.col("plane")
    video = cells.select("key", "i", _t(F.floor(F.col("i") / F.col("plane")), F.col("sec"), clock).alias("t"), F.floor(cell / F.col("gw")).cast("long").alias("h"), (F.col("i") % F.col("gw")).alias("w"))
    audio = av.select(key, F.explode(_upto(F.col("heard"))).alias("i")).select("key", "i", F.col("i").alias("t"), F.col("i").alias("h"), F.col("i").alias("w"))
    # chunks by W8 need only the time axis; the other two ride along
    parts = [time_chunks(d, width, "key", "h", "w").withColumn("rank", F.lit(r)) for r, d in enumerate((video, audio))]
    rows = parts[0].unionByName(parts[1])
    top = F.greatest("t", "h", "w")
    whole = Window.partitionBy("key")
    final = F.max(F.struct("chunk", "rank", top.alias("top"))).over(whole)["top"]
    place = (F.row_number().over(whole.orderBy("chunk", "rank", "i")) - 1).cast("long")
    return rows.select("key.sample_id", "key.island", place.alias("o"), F.col("t").alias("rt"), F.col("h").alias("rh"), F.col("w").alias("rw"), (final + 1).alias("step"), F.max(top).over(whole).alias("top"))


def positions_from_ids(tokens: DataFrame, grids: DataFrame | None, audios: DataFrame, audio_in_video: bool = False, ids: Mapping[str, int] = IDS, clock: int = CLOCK, seconds_per_chunk: float = SECONDS_PER_CHUNK, merge: int = 2) -> DataFrame:
    """``(sample_id, pos, t, h, w, delta, error)`` for every row of ``tokens`` (``sample_id, pos, token_id, mask``).

    ``grids``: ``sample_id, modality (image, video), k, grid_t, grid_h, grid_w, sec``; ``audios``: ``sample_id, k, mel_len``.
    Padded rows hold 1. ``delta`` is one past the largest position less the unpadded rows. Without ``grids`` (None) rows
    just count, as text does. With ``audio_in_video``, a video's rows are followed chunk by chunk by those of its audio,
    the two starts before it share a position and so do the two ends after it; a next start can then lie below
    positions that came before. A sample whose rows, grids and lengths disagree, or whose media lack their start, has no
    positions but an ``error`` on each row.
    """
    if grids is None:
        rows = positions_text(tokens)
        return rows.select("sample_id", F.col("pos").cast("long").alias("pos"), *[F.col("position").alias(a) for a in "thw"], "delta", F.lit(None).cast("string").alias("error"))
    # written once, as it is read three times. Its rows are few bytes and much work: shuffles of a size in bytes would
    # leave more of them to a task as the input grows
    tokens = cut(tokens.select("sample_id", "pos", "token_id", "mask"))
    width = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens.count() // TASK_ROWS))
    rows = _island_rows(tokens.where("mask = 1").repartition(width, "sample_id"), ids, audio_in_video)
    # a row for each island, read several times below: written once
    islands = cut(_measured(_islands(rows, ids, audio_in_video), grids, audios, clock, merge))
    w = Window.partitionBy("sample_id").orderBy("island")
    if audio_in_video:
        av = islands.where("kind = 'av' AND error IS NULL")
        mixed = cut(_interleaved(av, clock, int(clock * seconds_per_chunk)))
        steps = mixed.groupBy("sample_id", "island").agg(F.max("step").alias("step"), F.max("top").alias("top"))
        islands = islands.join(steps, ["sample_id", "island"], "left")
        # the second of two starts and of two ends stands where the first does
        paired = lambda other: F.coalesce(other == "av", F.lit(False)).cast("long")
        islands = islands.withColumn("ends", F.when(F.col("kind") == "text", paired(F.lag("kind").over(w))).otherwise(0)).withColumn("starts", F.when(F.col("kind") == "text", paired(F.lead("kind").over(w))).otherwise(0))
        short = (F.col("kind") == "text") & (F.col("n") < 2 * (F.col("ends") + F.col("starts")))
        islands = islands.withColumn("error", F.when(short, "start_missing").otherwise(F.col("error")))
        advance = F.when(F.col("kind") == "av", F.col("step")).otherwise(F.col("span") - F.col("ends") - F.col("starts"))
        reach = F.when(F.col("kind") == "av", F.col("top") + 1).otherwise(F.col("span") - F.col("ends") - F.col("starts"))
    else:
        islands = islands.withColumn("ends", F.lit(0)).withColumn("starts", F.lit(0))
        advance = reach = F.col("span")
    whole = Window.partitionBy("sample_id")
    islands = islands.withColumn("error", F.min("error").over(whole)).withColumn("advance", advance).withColumn("reach", reach)
    islands = islands.withColumn("start", _before(F.col("advance"), "island", by="sample_id"))
    islands = islands.withColumn("delta", F.max(F.col("start") + F.col("reach")).over(whole) - F.sum("n").over(whole))
    placed = rows.select("sample_id", "pos", "i", "island").join(islands.select("sample_id", "island", "kind", "first", "n", "gh", "gw", "sec", "ends", "starts", "start", "delta", "error"), ["sample_id", "island"])
    placed = placed.withColumn("o", F.col("i") - F.col("first"))
    plane = F.col("gh") * F.col("gw")
    vision = F.col("kind").isin("image", "video")
    back = F.when((F.col("ends") == 1) & (F.col("o") >= 1), 1).otherwise(0) + F.when((F.col("starts") == 1) & (F.col("o") == F.col("n") - 1), 1).otherwise(0)
    flat = F.col("o") - back
    axes = {"t": F.when(vision, _t(F.floor(F.col("o") / plane), F.col("sec"), clock)).otherwise(flat), "h": F.when(vision, F.floor((F.col("o") % plane) / F.col("gw")).cast("long")).otherwise(flat), "w": F.when(vision, F.col("o") % F.col("gw")).otherwise(flat)}
    if audio_in_video:
        placed = placed.join(mixed.select("sample_id", "island", "o", "rt", "rh", "rw"), ["sample_id", "island", "o"], "left")
        axes = {a: F.when(F.col("kind") == "av", F.col(f"r{a}")).otherwise(v) for a, v in axes.items()}
    good = F.col("error").isNull()
    placed = placed.select("sample_id", "pos", *[F.when(good, F.col("start") + v).cast("long").alias(a) for a, v in axes.items()], F.when(good, F.col("delta")).alias("delta"), "error")
    # padded rows, with the delta and error of their sample
    own = islands.groupBy("sample_id").agg(F.first("delta").alias("delta"), F.first("error").alias("error"))
    padded = tokens.where("mask = 0").select("sample_id", "pos").join(own, "sample_id", "left")
    padded = padded.select("sample_id", "pos", *[F.when(F.col("error").isNull(), 1).cast("long").alias(a) for a in "thw"], F.when(F.col("error").isNull(), F.col("delta")).alias("delta"), "error")
    return placed.unionByName(padded).withColumn("pos", F.col("pos").cast("long"))
