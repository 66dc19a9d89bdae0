"""Sequence layout: chunks, offsets, tiles, positions, interleaving, fan-out and slices.

Every window is partitioned by its sample, item or conversation. What the sequential form carries from step to step
is a prefix sum over segments here, and tokens come out of one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty for n <= 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def _before(value: Column, *order: str, by: str) -> Column:
    """The sum of ``value`` over earlier rows of the partition, 0 at the first."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def audio_chunks(items: DataFrame, n_window: int = 100, key: str = "audio_id", length: str = "mel_len") -> DataFrame:
    """``(key, chunk, len, half)``: chunks of ``2 * n_window`` frames, and their lengths after stride 2; none for 0."""
    size = 2 * n_window
    n = F.ceil(F.col(length) / float(size))
    rows = items.select(key, length, F.explode(_upto(n)).alias("chunk"))
    own = F.least(F.lit(size).cast("long"), F.col(length) - F.col("chunk") * size)
    return rows.select(key, "chunk", own.alias("len"), (F.floor((own - 1) / 2.0) + 1).cast("long").alias("half"))


def chunk_offsets(chunks: DataFrame, key: str = "audio_id") -> DataFrame:
    """Half-open ``[start, stop)`` of every chunk inside its item."""
    start = _before(F.col("half"), "chunk", by=key)
    return chunks.withColumn("start", start).withColumn("stop", F.col("start") + F.col("half"))


def frame_offsets(grids: DataFrame, key: str = "media_id") -> DataFrame:
    """``(key, frame, start, stop)``: a frame holds h * w cells."""
    size = F.col("grid_h") * F.col("grid_w")
    rows = grids.select(key, size.alias("size"), F.explode(_upto(F.col("grid_t"))).alias("frame"))
    return rows.select(key, "frame", (F.col("frame") * F.col("size")).alias("start"), ((F.col("frame") + 1) * F.col("size")).alias("stop"))


def _tiled(t: Column, y: Column, x: Column, height: Column, width: Column, k: int) -> tuple[Column, Column, Column]:
    """``(index, start, cells)``: a cell's place in tile-major order, its tile's first place and size.

    Tiles above and to the left of a cell's own are whole, so places follow from arithmetic alone.
    """
    top, left = y - y % k, x - x % k
    rows, cols = F.least(F.lit(k), height - top), F.least(F.lit(k), width - left)
    start = t * height * width + top * width + rows * left
    return start + (y - top) * cols + (x - left), start, rows * cols


def _cells(height: Column, width: Column) -> list[Column]:
    """``t, y, x`` of the column ``cell``, which runs over frames, rows and columns."""
    plane = height * width
    return [F.floor(F.col("cell") / plane).cast("long").alias("t"), F.floor((F.col("cell") % plane) / width).cast("long").alias("y"), (F.col("cell") % width).cast("long").alias("x")]


def spatial_tiles(grids: DataFrame, k: int = 4, merge: int = 2, key: str = "media_id") -> DataFrame:
    """Merged cells of each medium in tile-major order: ``(key, idx, cell, tile, tile_start, tile_cells)``.

    Narrow: each grid is laid out by itself, without a shuffle.
    """
    rows = grids.select(key, "grid_t", F.floor(F.col("grid_h") / float(merge)).cast("long").alias("gh"), F.floor(F.col("grid_w") / float(merge)).cast("long").alias("gw"))
    gh, gw, t, y, x = (F.col(c) for c in ("gh", "gw", "t", "y", "x"))
    rows = rows.select("*", F.explode(_upto(F.col("grid_t") * gh * gw)).alias("cell")).select(key, "gh", "gw", "cell", *_cells(gh, gw))
    tile = (t * F.ceil(gh / float(k)) + F.floor(y / float(k))) * F.ceil(gw / float(k)) + F.floor(x / float(k))
    idx, start, cells = _tiled(t, y, x, gh, gw, k)
    return rows.select(key, idx.cast("long").alias("idx"), "cell", tile.cast("long").alias("tile"), (start * merge * merge).cast("long").alias("tile_start"), (cells * merge * merge).cast("long").alias("tile_cells"))


def grid_coords(grids: DataFrame, merge: int = 2, key: str = "media_id") -> DataFrame:
    """``(key, idx, h, w)``: patches in merge-block order, repeated for each frame (W5). Narrow, like ``spatial_tiles``."""
    gh, gw = F.col("grid_h"), F.col("grid_w")
    rows = grids.select(key, "grid_h", "grid_w", F.explode(_upto(F.col("grid_t") * gh * gw)).alias("cell")).select(key, "grid_h", "grid_w", *_cells(gh, gw))
    idx, _, _ = _tiled(F.col("t"), F.col("y"), F.col("x"), gh, gw, merge)
    return rows.select(key, idx.cast("long").alias("idx"), F.col("y").alias("h"), F.col("x").alias("w"))


def positions_text(tokens: DataFrame) -> DataFrame:
    """``(sample_id, pos, position, delta)``: running count of unmasked rows, 1 at masked ones."""
    seen = F.sum("mask").over(Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = tokens.withColumn("position", F.when(F.col("mask") == 0, 1).otherwise(seen).cast("long"))
    whole = Window.partitionBy("sample_id")
    return rows.select("sample_id", "pos", "position", (F.max("position").over(whole) + 1 - F.sum("mask").over(whole)).cast("long").alias("delta"))


def segment_starts(segments: DataFrame, clock: int = 25, merge: int = 2) -> DataFrame:
    """Segments with ``start``: each begins one past the largest position of those before it."""
    vision = F.col("kind").isin("image", "video")
    gh, gw = F.floor(F.col("grid_h") / float(merge)).cast("long"), F.floor(F.col("grid_w") / float(merge)).cast("long")
    last = ((F.col("grid_t") - 1) * F.col("sec") * clock).cast("long")
    span = F.when(vision, F.greatest(last, gh - 1, gw - 1) + 1).otherwise(F.col("len"))
    rows = segments.withColumn("gh", gh).withColumn("gw", gw).withColumn("span", span)
    return rows.withColumn("start", _before(F.col("span"), "seg_no", by="sample_id"))


def positions_multimodal(segments: DataFrame, clock: int = 25, merge: int = 2) -> DataFrame:
    """``(sample_id, idx, t, h, w, delta)`` for every token of the segments, padding left out.

    Samples without an image or video are text-like: their positions just count.
    """
    rows = segment_starts(segments, clock, merge)
    whole = Window.partitionBy("sample_id")
    rows = rows.withColumn("offset", _before(F.col("len"), "seg_no", by="sample_id"))
    rows = rows.withColumn("delta", (F.max(F.col("start") + F.col("span")).over(whole) - F.sum("len").over(whole)).cast("long"))
    rows = rows.select("*", F.explode(_upto(F.col("len"))).alias("i"))
    vision, plane = F.col("kind").isin("image", "video"), F.col("gh") * F.col("gw")
    t = F.when(vision, (F.floor(F.col("i") / plane) * F.col("sec") * clock).cast("long")).otherwise(F.col("i"))
    h = F.when(vision, F.floor((F.col("i") % plane) / F.col("gw")).cast("long")).otherwise(F.col("i"))
    w = F.when(vision, F.col("i") % F.col("gw")).otherwise(F.col("i"))
    return rows.select("sample_id", (F.col("offset") + F.col("i")).alias("idx"), *[(F.col("start") + v).cast("long").alias(n) for n, v in (("t", t), ("h", h), ("w", w))], "delta")


def time_chunks(timed: DataFrame, width: int = 10, key: str = "item", *also: str) -> DataFrame:
    """``(key, i, t, chunk)`` of a time-sorted sequence: at most one cut before each row (W8); columns ``also`` stay.

    The number of cuts so far is i + min(1, min over j <= i of (floor((t_j - t_0) / width) - j)), at least 0.
    """
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    due = F.floor((F.col("t") - F.first("t").over(w)) / float(width)) - F.col("i")
    rows = timed.withColumn("due", due)
    return rows.select(key, "i", "t", *also, (F.col("i") + F.least(F.lit(1), F.min("due").over(w))).cast("long").alias("chunk"))


def interleave(video: DataFrame, audio: DataFrame, width: int = 50, key: str = "item") -> DataFrame:
    """Chunks of two time-sorted sequences side by side, video first.

    Inputs have ``key, i, t, m`` (``m`` the largest of a row's positions). ``(key, idx, kind, i, t, chunk, next_start)``;
    the next start is one past the largest position of the last chunk part that is not empty.
    """
    parts = [time_chunks(d, width, key, "m").withColumn("rank", F.lit(r)) for r, d in enumerate((video, audio))]
    rows = parts[0].unionByName(parts[1])
    order = Window.partitionBy(key).orderBy("chunk", "rank", "i")
    last = Window.partitionBy(key, "chunk", "rank")
    rows = rows.withColumn("top", F.max("m").over(last))
    final = F.max(F.struct("chunk", "rank", "top")).over(Window.partitionBy(key))["top"] + 1
    return rows.select(key, (F.row_number().over(order) - 1).cast("long").alias("idx"), F.when(F.col("rank") == 0, "video").otherwise("audio").alias("kind"), "i", "t", "chunk", final.cast("long").alias("next_start"))


def media_counts(tokens: DataFrame, start_id: int = 90001, image_id: int = 90003, video_id: int = 90004, audio_start_id: int = 90006) -> DataFrame:
    """``images, videos, audios, error`` per sample.

    Images and videos are such tokens right after a start token, the first row following the last; audios are audio
    starts. A sample with audio has one vision start, whose medium is what the sample holds; more or fewer starts, or
    images beside videos, are the error ``vision_mix``.
    """
    w = Window.partitionBy("sample_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("token_id").over(w), F.last("token_id").over(whole))
    rows = tokens.withColumn("before", before)
    held = lambda i: F.count(F.when(F.col("token_id") == i, 1))
    hit = lambda i: F.count(F.when((F.col("before") == start_id) & (F.col("token_id") == i), 1))
    n = rows.groupBy("sample_id").agg(hit(image_id).alias("i"), hit(video_id).alias("v"), held(image_id).alias("all_i"), held(video_id).alias("all_v"), held(start_id).alias("starts"), held(audio_start_id).alias("audios"))
    heard = F.col("audios") > 0
    count = lambda own, every: F.when(~heard, F.col(own)).when(F.col(every) > 0, F.col("starts")).otherwise(F.lit(0).cast("long"))
    mixed = heard & (((F.col("all_i") > 0) & (F.col("all_v") > 0)) | (F.col("starts") != 1))
    return n.select("sample_id", count("i", "all_i").alias("images"), count("v", "all_v").alias("videos"), "audios", F.when(mixed, "vision_mix").alias("error"))


def visible_context(tokens: DataFrame, *windows: int) -> DataFrame:
    """Keys that each row sees, itself and unpadded earlier ones, as ``visible``; for each of the sliding ``windows``
    those within it, as ``visible_<window>`` (W11). All frames share one sort."""
    order = Window.partitionBy("sample_id").orderBy("pos")
    seen = lambda first: F.sum("mask").over(order.rowsBetween(first, 0)).cast("long")
    return tokens.select("sample_id", "pos", seen(Window.unboundedPreceding).alias("visible"), *[seen(1 - n).alias(f"visible_{n}") for n in windows])


def continuation_positions(steps: DataFrame, key: str = "conv") -> DataFrame:
    """``(key, batch, i, position, thinker_position)``: rows of appended batches count on.

    ``steps`` may give the ``delta`` between a key's next position and its rows so far, and its number of ``padded``
    rows, which only the second position leaves out; without them both are 0.
    """
    given = lambda c: F.col(c).cast("long") if c in steps.columns else F.lit(0).cast("long")
    rows = steps.withColumn("seen", _before(F.col("len"), "batch", by=key) + given("delta")).withColumn("less", given("padded"))
    rows = rows.select(key, "batch", F.explode(_upto(F.col("len"))).alias("i"), "seen", "less")
    return rows.select(key, "batch", "i", (F.col("seen") + F.col("i")).alias("position"), (F.col("seen") - F.col("less") + F.col("i")).alias("thinker_position"))


def masked_rows(features: DataFrame, key: str = "item", order: str = "pos", mask: str = "mask") -> DataFrame:
    """Feature rows whose mask is 1, with ``k``, their place among the rows that stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return features.where(F.col(mask) == 1).withColumn("k", place.cast("long")).drop(mask)


def right_padding(tokens: DataFrame) -> DataFrame:
    """Samples whose last row is padding."""
    return tokens.groupBy("sample_id").agg(F.max_by("mask", "pos").alias("last_mask")).select("sample_id", (F.col("last_mask") == 0).alias("right_padded"))


def fan_out(samples: DataFrame, copies: int = 8) -> DataFrame:
    """Each row ``copies`` times, as ``g`` 0 .. copies - 1."""
    return samples.select("*", F.explode(_upto(F.lit(copies))).alias("g"))


def codec_repeat(codes: DataFrame, times: int = 2, drop_code: bool = False) -> DataFrame:
    """``(item, pos, code)``: each code ``times`` times in place, or zeros."""
    rows = codes.select("item", F.col("pos").alias("p"), "code", F.explode(_upto(F.lit(times))).alias("k"))
    code = F.lit(0).cast("long") if drop_code else F.col("code")
    return rows.select("item", (F.col("p") * times + F.col("k")).cast("long").alias("pos"), code.alias("code"))


def talker_inputs(ids: DataFrame, speaker_bos: Column, mask_id: int = 0, pad_id: int = 1, bos_id: int = 2) -> DataFrame:
    """``(sample_id, ids, codes, mask)``: prompt ids, speaker start and first reply; a parallel row of codes.

    ``ids`` has ``sample_id, prompt ARRAY, first_reply``.
    """
    text = F.concat("prompt", F.array(speaker_bos, F.col("first_reply")))
    codes = F.concat(F.array_repeat(F.lit(mask_id).cast("long"), F.size("prompt")), F.array(F.lit(pad_id).cast("long"), F.lit(bos_id).cast("long")))
    return ids.select("sample_id", text.alias("ids"), codes.alias("codes"), F.array_repeat(F.lit(1).cast("long"), F.size("prompt") + 2).alias("mask"))


def completion(ids: Column, prompt_len: Column, drop_last: int = 0) -> Column:
    """What follows the prompt, without the last ``drop_last`` ids (L1)."""
    return F.slice(ids, prompt_len.cast("int") + 1, F.greatest(F.size(ids) - prompt_len.cast("int") - drop_last, F.lit(0)))


def strip_special(ids: Column, special: list[int]) -> Column:
    """Ids without the special ones."""
    return F.filter(ids, lambda x: ~x.isin(special))


def offsets_dedup(offsets: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Consecutive equal offsets once."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return offsets.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")
