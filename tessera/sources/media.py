"""Sources and sinks: conversations, media payloads by path, inline or fetched, and the partitioned sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def assemble(messages: DataFrame) -> DataFrame:
    """One row per conversation, its messages in turn order."""
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


#: Files that are named to the reader one by one; of more, the folder is read and joined.
NAMED_FILES = 100_000


def local_path(uri: Column) -> Column:
    """The path of a local reference; ``file://`` is stripped."""
    return F.when(uri.startswith("file://"), F.substring(uri, 8, 2**31 - 1)).otherwise(uri)


def _escaped(path: str) -> str:
    """A path that a reader which expands patterns takes as it is."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def referenced_files(refs: DataFrame, folder: str, glob: str = "*", most: int = NAMED_FILES) -> DataFrame:
    """Files of ``folder`` (``path, bytes, payload``) that ``refs`` (with ``path``) name.

    First the folder is listed, without content, and joined with the paths; then only what is named is read.
    """
    spark = refs.sparkSession
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    plain = F.regexp_replace("path", "^file:/*", "/")
    listed = found.select(F.col("path").alias("file"), plain.alias("path")).join(refs.select("path").distinct(), "path", "left_semi")
    names = [r.file for r in listed.select("file").limit(most + 1).collect()]
    if 0 < len(names) <= most:
        found = spark.read.format("binaryFile").load([_escaped(n) for n in names])
    elif not names:
        found = found.limit(0)
    return found.select(plain.alias("path"), F.col("length").alias("bytes"), F.col("content").alias("payload"))


def payload_by_path(refs: DataFrame, folder: str, glob: str = "*", most: int = NAMED_FILES) -> DataFrame:
    """``refs`` (with ``uri``) joined to the files of ``folder`` on the normalised path (S2); ``error`` where there is none."""
    rows = refs.withColumn("path", local_path(F.col("uri")))
    found = rows.join(referenced_files(rows, folder, glob, most), "path", "left")
    return found.withColumn("error", F.when(F.col("payload").isNull(), "no_file"))


def inline_payload(refs: DataFrame) -> DataFrame:
    """``payload`` and ``error`` for ``data:`` references: what follows the first ``base64,`` (S3)."""
    parts = F.split("uri", "base64,", 2)
    marked = F.size(parts) == 2
    payload = F.when(marked, F.try_to_binary(parts[1], F.lit("base64")))
    return refs.where(F.col("uri").startswith("data:")).withColumn("payload", payload).withColumn("error", F.when(~marked, F.concat(F.col("modality"), F.lit("_unrecognised"))))


def remote_payload(refs: DataFrame, fetched: DataFrame) -> DataFrame:
    """References over http(s) joined to what was fetched before (``url, payload``); none in a task's hands."""
    remote = refs.where(F.col("uri").startswith("http://") | F.col("uri").startswith("https://"))
    found = remote.join(fetched.select(F.col("url").alias("uri"), "payload"), "uri", "left")
    return found.withColumn("error", F.when(F.col("payload").isNull(), "not_fetched"))


#: Codes of the error contract that planned rows can carry (P10).
CODES = ("ratio", "zero_side", "fps_and_nframes", "nframes_range", "image_unrecognised", "audio_unknown", "video_unknown", "audio_not_mono", "no_audio_track", "no_media_key", "frame_sizes_differ", "not_in_catalog")


def write_quarantined(planned: DataFrame, path: str, codes: tuple[str, ...] = CODES) -> dict[str, int]:
    """Planned rows in Parquet under ``kept=good`` or, with an ``error``, ``kept=bad`` and their code; counts of the codes.

    One job plans, writes and counts: the counts are observed while the rows go by.
    """
    seen = Observation()
    rows = planned.observe(seen, *[F.count(F.when(F.col("error") == c, 1)).alias(c) for c in codes])
    split = F.when(F.col("error").isNull(), "good").otherwise("bad")
    rows.withColumn("kept", split).withColumn("code", F.coalesce("error", F.lit("none"))).write.mode("overwrite").partitionBy("kept", "code").parquet(path)
    return dict(seen.get)


def write_by_modality(media: DataFrame, path: str) -> None:
    """The sink: Parquet, a folder for each modality."""
    media.write.mode("overwrite").partitionBy("modality").parquet(path)
