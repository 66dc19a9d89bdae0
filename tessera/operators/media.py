"""Plans of sizes, frames and tokens over media tables, and their assembly per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import content as C

MAX_PROMPT_TOKENS = 32768


def plan_images(images: DataFrame, frame: bool = False) -> DataFrame:
    """``h, w, error`` for rows with ``height, width, resized_height, resized_width, min_pixels, max_pixels`` (M4, M5).

    Two given sizes are resized within the default image bounds; else the original within given or default bounds.
    """
    return images.withColumn("r", image_size(F.lit(frame))).select(*images.columns, "r.h", "r.w", "r.error")


def _given() -> Column:
    return F.col("resized_height").isNotNull() & F.col("resized_width").isNotNull()


def _sides() -> tuple[Column, Column]:
    """The sides to resize: those given, where both are, else the medium's own."""
    return F.when(_given(), F.col("resized_height")).otherwise(F.col("height")), F.when(_given(), F.col("resized_width")).otherwise(F.col("width"))


def _image_bounds(frame: Column) -> tuple[Column, Column]:
    """Bounds of the image policy (M5), with a video frame's defaults where ``frame``; given sizes keep to the image's."""
    low, high = (F.when(frame, E.FRAME_PIXELS[k]).otherwise(E.IMAGE_PIXELS[k]) for k in (0, 1))
    return F.when(_given(), E.IMAGE_PIXELS[0]).otherwise(F.coalesce("min_pixels", low)), F.when(_given(), E.IMAGE_PIXELS[1]).otherwise(F.coalesce("max_pixels", high))


def image_size(frame: Column) -> Column:
    return E.smart_resize(*_sides(), *_image_bounds(frame))


def _counted() -> Column:
    return E.frame_count(F.col("total_frames"), F.col("video_fps"), F.col("fps"), F.col("nframes"), F.col("min_frames"), F.col("max_frames"))


def _budget(n: Column) -> Column:
    return E.frame_budget(n, F.col("min_pixels"), F.col("max_pixels"), F.col("total_pixels"))


def _least_pixels() -> Column:
    return F.coalesce(F.col("min_pixels").cast("double"), F.lit(float(E.FRAME_PIXELS[0])))


def plan_videos(videos: DataFrame) -> DataFrame:
    """``n, sample_fps, budget, h, w, error`` for rows with ``total_frames, video_fps, height, width`` and optional settings (M6-M9)."""
    rows = videos.withColumn("c", _counted()).select(*videos.columns, F.col("c.n").alias("n"), F.col("c.error").alias("count_error"))
    rows = rows.withColumn("budget", _budget(F.col("n")))
    rows = rows.withColumn("r", F.when(F.col("n").isNotNull(), E.smart_resize(*_sides(), _least_pixels(), F.col("budget"))))
    fps = E.sampled_fps(F.col("n"), F.col("total_frames"), F.col("video_fps"))
    return rows.select(*videos.columns, "n", fps.alias("sample_fps"), "budget", "r.h", "r.w", F.coalesce("count_error", "r.error").alias("error"))


def sample_frames(planned: DataFrame, key: str = "video_id") -> DataFrame:
    """``(key, k, frame)`` for the frames that a plan takes (M7)."""
    ok = planned.where(F.col("n").isNotNull())
    return ok.select(key, F.posexplode(E.frame_indices(F.col("n"), F.col("total_frames"))).alias("k", "frame")).withColumn("k", F.col("k").cast("long"))


def trim(frames: DataFrame, start: Column, end: Column, key: str = "video_id") -> DataFrame:
    """``(key, total_frames, first_frame)`` of the frames with ``start <= pts <= end``; an open end is null."""
    kept = frames.where((F.col("pts") >= F.coalesce(start, F.lit(0.0))) & (end.isNull() | (F.col("pts") <= end)))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("total_frames"), F.min("frame_no").alias("first_frame"))


def plan_frame_lists(frames: DataFrame, images: DataFrame, key: str | list[str] = "video_id") -> DataFrame:
    """Frame-list videos (M11): each frame planned as a video frame, padded to an even number by the last one.

    ``frames``: key columns, ``frame_no, image_id`` and the settings that frames inherit; an empty list is one row
    whose ``frame_no`` is null. One row per video: ``n, frames, h, w, fps, error``; sizes that disagree, or an empty
    list, give ``frame_sizes_differ``.
    """
    keys = [key] if isinstance(key, str) else key
    none = {c: F.lit(None).cast("long") for c in ("resized_height", "resized_width", "min_pixels", "max_pixels")}
    sized = plan_images(frames.join(images, "image_id", "left").withColumns({c: v for c, v in none.items() if c not in frames.columns}), frame=True)
    one = F.sort_array(F.collect_list(F.when(F.col("frame_no").isNotNull(), F.struct("frame_no", "image_id", "h", "w", "error"))))
    rows = sized.groupBy(*keys).agg(one.alias("f"))
    ids, some = F.col("f.image_id"), F.size("f") > 0
    padded = F.when(some, F.concat(ids, F.array_repeat(F.try_element_at(ids, F.lit(-1)), (F.size(ids) % 2)))).otherwise(ids)
    sizes = F.array_distinct(F.transform("f", lambda x: F.struct(x["h"], x["w"])))
    first = F.try_element_at("f", F.lit(1))
    error = F.coalesce(F.try_element_at(F.filter(F.col("f.error"), lambda e: e.isNotNull()), F.lit(1)), F.when(F.size(sizes) != 1, "frame_sizes_differ"))
    return rows.select(*keys, F.size(padded).cast("long").alias("n"), padded.alias("frames"), first["h"].alias("h"), first["w"].alias("w"), F.lit(2.0).alias("fps"), error.alias("error"))


def catalog(images: DataFrame, videos: DataFrame, audios: DataFrame) -> DataFrame:
    """The three catalogs as one, keyed by ``kind, id``, so that elements of all kinds meet theirs in one join."""
    fields = {"height": "long", "width": "long", "total_frames": "long", "video_fps": "double", "has_audio": "boolean", "mel_len": "long", "channels": "int"}
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("long").alias("id"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    return of(images, "image").unionByName(of(videos, "video")).unionByName(of(audios, "audio"))


def plan_elements(messages: DataFrame, catalogs: DataFrame, use_audio_in_video: bool = True, strict: bool = False) -> DataFrame:
    """Every element of ``messages`` planned (M4-M13): ``(conv_id, turn, elem_pos, role, modality, n, sample_fps, h, w,
    height, width, tokens, error)``, in one scan, one join with the catalogs and one aggregation.

    ``role`` is text, vision, audio, or track (the audio of a video, P4); an element that is several has a row of each.
    ``n`` is a video's frames. Frame lists are planned frame by frame with the element's settings, padded to an even
    number (M11). What has no entry in its catalog is ``not_in_catalog``. With ``strict`` the first code fails the run.
    """
    parts = C.elements(messages, plain=True)
    track = F.lit(use_audio_in_video) & (F.col("type") == "video")
    roles = F.array_compact(F.array(F.when(F.col("type") == "text", "text"), F.when(C.is_vision(), "vision"), F.when(F.col("type") == "audio", "audio"), F.when(track, "track")))
    rows = parts.withColumn("role", F.explode(roles))
    listed = (F.col("role") == "vision") & (C.modality() == "video") & F.col("frames").isNotNull()
    rows = rows.withColumn("listed", F.coalesce(listed, F.lit(False)))
    rows = rows.select("*", F.posexplode_outer(F.when(F.col("listed"), F.col("frames"))).alias("frame_no", "frame"))
    modality = F.when(F.col("role") == "vision", C.modality()).otherwise(F.when(F.col("role") == "text", "text").otherwise("audio"))
    image = F.when(C.has("image"), F.col("image")).otherwise(F.col("image_url"))
    uri = F.when(F.col("listed"), F.col("frame")).when(modality == "image", image).when((modality == "video") | (F.col("role") == "track"), F.col("video")).when(F.col("role") == "audio", F.col("audio"))
    kind = F.when(F.col("listed") | (modality == "image"), "image").when((modality == "video") | (F.col("role") == "track"), "video").otherwise(modality)
    # rows without a reference get ids that no catalog has, each its own, so they do not meet in one task
    nowhere = -1 - F.abs(F.xxhash64("conv_id", "turn", "elem_pos") % F.lit(1 << 40)) - (1 << 40)
    inline = (modality == "image") & F.startswith("uri", F.lit("data:image")) & ~F.contains("uri", F.lit("base64,"))
    rows = rows.withColumn("modality", modality).withColumn("uri", uri).withColumn("kind", kind).withColumn("id", F.coalesce(C.media_id(F.col("uri")), nowhere)).withColumn("inline", inline)
    audio_missing = F.when((F.col("role") == "audio") & ~C.has("audio"), "audio_unknown").when((F.col("role") == "track") & ~C.has("video"), "video_unknown")
    early = F.when((F.col("role") == "vision") & F.col("modality").isNull(), "no_media_key").when(F.col("inline"), "image_unrecognised")
    rows = rows.withColumn("early", F.coalesce(early, audio_missing)).join(catalogs, ["kind", "id"], "left")

    still = (F.col("role") == "vision") & (F.col("frame").isNotNull() | (F.col("modality") == "image"))
    moving = (F.col("role") == "vision") & (F.col("modality") == "video") & ~F.col("listed")
    rows = rows.withColumn("c", F.when(moving & F.col("total_frames").isNotNull(), _counted()))
    rows = rows.withColumn("budget", _budget(F.col("c.n")))
    lo, hi = (F.when(still, i).otherwise(v) for i, v in zip(_image_bounds(F.col("listed")), (_least_pixels(), F.col("budget"))))
    rows = rows.withColumn("lo", lo).withColumn("hi", hi)
    rows = rows.withColumn("r", F.when(still | F.col("c.n").isNotNull(), E.smart_resize(*_sides(), F.col("lo"), F.col("hi"))))
    rows = rows.withColumn("rate", E.sampled_fps(F.col("c.n"), F.col("total_frames"), F.col("video_fps")))
    absent = F.when(still & ~F.col("listed") & F.col("height").isNull() | moving & F.col("total_frames").isNull() | (F.col("role") == "audio") & F.col("mel_len").isNull(), "not_in_catalog")
    silent = F.when((F.col("role") == "track") & ~F.coalesce("has_audio", F.lit(False)), "no_audio_track").when((F.col("role") == "audio") & (F.col("channels") > 1), "audio_not_mono")
    rows = rows.withColumn("error", F.coalesce("early", absent, "c.error", "r.error", silent))
    one = F.struct("r.h", "r.w", "height", "width")
    bad = F.when(F.col("error").isNotNull(), F.coalesce("frame_no", F.lit(0)))
    keys = ["conv_id", "turn", "elem_pos", "role"]
    whole = lambda c: F.coalesce(c, F.lit(-1))
    found = rows.groupBy(*keys).agg(
        F.max("modality").alias("modality"), F.max("listed").alias("listed"), F.count("frame").alias("held"), F.max("c.n").alias("moved"), F.max("rate").alias("rate"), F.min_by(one, F.coalesce("frame_no", F.lit(0))).alias("first"),
        ((F.min(whole("r.h")) != F.max(whole("r.h"))) | (F.min(whole("r.w")) != F.max(whole("r.w")))).alias("differ"), F.min_by("error", bad).alias("code"), F.max(F.length("text")).alias("chars"), F.max("mel_len").alias("mel_len"),
    )
    n = F.when(F.col("listed"), F.col("held") + F.col("held") % 2).otherwise(F.col("moved"))
    fps = F.when(F.col("listed"), F.lit(2.0)).otherwise(F.col("rate"))
    error = F.coalesce("code", F.when(F.col("listed") & (F.col("differ") | (F.col("held") == 0)), "frame_sizes_differ"))
    found = found.select(*keys, "modality", F.when(F.col("modality") == "video", n).alias("n"), F.when(F.col("modality") == "video", fps).alias("sample_fps"), "first.h", "first.w", "first.height", "first.width", "chars", "mel_len", error.alias("error"))
    cost = F.when(F.col("role") == "text", F.ceil(F.col("chars") / 4.0).cast("long")).when(F.col("role") == "vision", planned_tokens(F.coalesce("n", F.lit(1).cast("long")), F.col("h"), F.col("w"))).when(F.col("role") == "audio", E.audio_lengths(F.col("mel_len"))["tokens"])
    found = found.select(*keys, "modality", "n", "sample_fps", "h", "w", "height", "width", F.when(F.col("error").isNull(), cost).alias("tokens"), "error")
    return C.checked(found, strict)


def grid(t: Column, h: Column, w: Column) -> tuple[Column, Column, Column]:
    """The patch grid of a planned medium: two frames and 14 pixels to a patch."""
    return F.ceil(t / 2.0).cast("long"), F.floor(h / float(E.PATCH)).cast("long"), F.floor(w / float(E.PATCH)).cast("long")


def planned_tokens(t: Column, h: Column, w: Column) -> Column:
    return E.vision_tokens(*grid(t, h, w))


def token_budget(planned: DataFrame, limit: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """Tokens per conversation by modality, and whether they fit ``limit`` (M14); ``planned`` from :func:`plan_elements`."""
    sums = [F.coalesce(F.sum(F.when(F.col("modality") == m, F.col("tokens"))), F.lit(0)).cast("long").alias(f"{m}_tokens") for m in ("text", "image", "video", "audio")]
    rows = planned.where("error IS NULL AND role <> 'track'").groupBy("conv_id").agg(*sums)
    total = F.col("text_tokens") + F.col("image_tokens") + F.col("video_tokens") + F.col("audio_tokens")
    return rows.withColumn("total_tokens", total).withColumn("fits", total <= limit)


def vision_result(planned: DataFrame) -> DataFrame:
    """Ordered lists per conversation, null where a modality has none (A5, P7): ``images`` of ``struct(h, w, height,
    width)``, ``videos`` with ``fps`` too; ``planned`` from :func:`plan_elements`, bad rows are left out."""
    rows = planned.where("error IS NULL AND role = 'vision'")
    order = F.struct("turn", "elem_pos", F.col("modality").alias("m"), "h", "w", "height", "width", F.col("sample_fps").alias("fps"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("all"))

    def listed(kind: str, *fields: str) -> Column:
        own = F.transform(F.filter("all", lambda x: x["m"] == kind), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
        return F.when(F.size(own) > 0, own)

    size = ("h", "w", "height", "width")
    return rows.select("conv_id", listed("image", *size).alias("images"), listed("video", *size, "fps").alias("videos"))


def vision_flat(planned: DataFrame) -> DataFrame:
    """The same media one by one (A5's flat view): ``n`` of a conversation's kind, ``idx`` in it, sizes and rate.

    Over a batch, media stand in the order of ``conv_id, idx``.
    """
    planned = planned.where("error IS NULL AND role = 'vision'")
    kind = Window.partitionBy("conv_id", "modality")
    idx = (F.row_number().over(kind.orderBy("turn", "elem_pos")) - 1).cast("long").alias("idx")
    return planned.select("conv_id", "modality", idx, F.count(F.lit(1)).over(kind).alias("n"), "h", "w", "height", "width", "sample_fps")

