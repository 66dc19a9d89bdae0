"""Conversations to media references: flattening, predicates, routing and URI schemes.

Key presence counts, not the value: a key that is there with null still routes. Everything is one narrow pass over
messages; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = {
    **dict.fromkeys(("type", "text", "image", "image_url", "audio", "video"), "string"), **dict.fromkeys(("resized_height", "resized_width", "min_pixels", "max_pixels"), "bigint"),
    **dict.fromkeys(("total_pixels", "fps", "nframes", "min_frames", "max_frames", "video_start", "video_end"), "double"),
}


def checked(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with their ``error`` codes (P10); with ``strict``, the first code met fails the run with its name."""
    if not strict:
        return rows
    return rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))


def has(*keys: str) -> Column:
    return F.coalesce(F.arrays_overlap("keys", F.array(*[F.lit(k) for k in keys])), F.lit(False))


def elements(messages: DataFrame, plain: bool = False) -> DataFrame:
    """``(conv_id, turn, elem_pos, keys, <element fields>, frames)`` in document order; string content has none.

    Content is parsed once, into maps of variants, so keys and values of either type come from the same parse: a
    ``video`` that is a list is ``frames``, any other is ``video``. With ``plain``, string content is a text element.
    """
    listed = F.col("content").startswith("[")
    rows = messages if plain else messages.where(listed)
    rows = rows.select("conv_id", "turn", "content", listed.alias("listed"), F.posexplode_outer(F.when(listed, F.from_json("content", "array<map<string,variant>>"))).alias("elem_pos", "m"))
    rows = rows.where(F.col("m").isNotNull() | ~F.col("listed"))  # what does not parse has no elements
    frames = F.try_variant_get(F.col("m")["video"], "$", "array<string>")
    fields = {name: F.try_variant_get(F.col("m")[name], "$", kind) for name, kind in ELEMENT.items()}
    fields["video"] = F.when(frames.isNull(), fields["video"])
    if plain:
        fields["type"] = F.when(F.col("listed"), fields["type"]).otherwise("text")
        fields["text"] = F.when(F.col("listed"), fields["text"]).otherwise(F.col("content"))
    return rows.select("conv_id", "turn", F.coalesce("elem_pos", F.lit(0)).cast("long").alias("elem_pos"), F.map_keys("m").alias("keys"), *[v.alias(k) for k, v in fields.items()], frames.alias("frames"))


def is_vision() -> Column:
    """A vision key, or else a vision type."""
    return has("image", "image_url", "video") | F.coalesce(F.col("type").isin("image", "image_url", "video"), F.lit(False))


def modality() -> Column:
    """image, video, or null where a vision element has no key to load from."""
    return F.when(has("image", "image_url"), "image").when(has("video"), "video")


def vision_elements(parts: DataFrame) -> DataFrame:
    """Vision elements with ``modality``, ``uri`` and ``error`` ``no_media_key``; ``image`` wins over ``image_url``."""
    image = F.when(has("image"), F.col("image")).otherwise(F.col("image_url"))
    uri = F.when(F.col("modality") == "image", image).otherwise(F.col("video"))
    rows = parts.where(is_vision()).withColumn("modality", modality()).withColumn("uri", uri)
    inline = (F.col("modality") == "image") & F.col("uri").startswith("data:image") & ~F.contains("uri", F.lit("base64,"))
    return rows.withColumn("error", F.when(F.col("modality").isNull(), "no_media_key").when(inline, "image_unrecognised"))


def audio_elements(parts: DataFrame) -> DataFrame:
    """Elements of type audio, with ``error`` ``audio_unknown`` where the key is missing."""
    return parts.where("type = 'audio'").withColumn("uri", F.col("audio")).withColumn("error", F.when(~has("audio"), "audio_unknown"))


def audio_refs(parts: DataFrame, video_has_audio: DataFrame, use_audio_in_video: bool = True) -> DataFrame:
    """Audio entries in document order, those of videos between the plain ones.

    ``video_has_audio`` has ``uri, has_audio``; a video that is not in it, or is silent, gives ``no_audio_track``.
    """
    video = (F.col("type") == "video") & F.lit(use_audio_in_video)
    rows = parts.where((F.col("type") == "audio") | video).withColumn("source", F.col("type"))
    rows = rows.withColumn("uri", F.when(F.col("type") == "audio", F.col("audio")).otherwise(F.col("video")))
    rows = rows.join(video_has_audio, "uri", "left")
    missing = F.when((F.col("source") == "audio") & ~has("audio"), "audio_unknown").when((F.col("source") == "video") & ~has("video"), "video_unknown")
    silent = (F.col("source") == "video") & ~F.coalesce("has_audio", F.lit(False))
    return rows.withColumn("error", F.coalesce(missing, F.when(silent, "no_audio_track")))


def uri_scheme(uri: Column) -> Column:
    """The branch by which a reference is loaded (P5)."""
    return F.when(uri.isNull(), "null").when(uri.startswith("http://"), "http").when(uri.startswith("https://"), "https").when(uri.startswith("file://"), "file").when(uri.startswith("data:image"), "data_image").when(uri.startswith("data:audio"), "data_audio").otherwise("path")


def media_id(uri: Column) -> Column:
    """The catalog key in a reference's file name; null for inline data."""
    return F.nullif(F.regexp_extract(uri, r"([0-9]+)\.[a-z0-9]+$", 1), F.lit("")).cast("long")
