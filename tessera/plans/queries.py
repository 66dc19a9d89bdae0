"""Every operator as a query over the given tables: ``QUERIES[name](spark, sf_dir)``."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import content as C
from tessera.operators import infer, joins, layout, media, mix, pool, positions
from tessera.plans.fixtures import table
from tessera.plans.session import checkpoint_dir
from tessera.sources import media as sources
from tessera.streaming import state

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _none(**kinds: str) -> dict:
    return {c: F.lit(None).cast(t) for c, t in kinds.items()}


def _r(name: str):
    return F.round(F.col(name), 6).alias(name)


def _elements(spark, sf):
    return C.elements(table(spark, sf, "messages"))


def _vision(spark, sf):
    return C.vision_elements(_elements(spark, sf))


def _video_audio(spark, sf):
    videos = table(spark, sf, "video_meta")
    return videos.select(F.concat(F.lit("file:///v/"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("uri"), "has_audio")


@query
def conversations_assembled(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources.assemble(table(spark, sf, "messages"))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join("messages.role", ",").alias("roles"), F.sha2(F.array_join("messages.content", "|"), 256).alias("content_sha"))


@query
def payload_by_path(spark, sf):
    names = F.array(*[F.lit(n) for n in ("region", "nation", "customer", "missing")])
    refs = table(spark, sf, "region").select("r_regionkey", F.explode(names).alias("name"))
    folder = sf if sf.startswith(("/", "file:")) else f"/{sf}"
    refs = refs.withColumn("uri", F.concat(F.lit("file://"), F.lit(folder.removeprefix("file://").rstrip("/") + "/"), "name", F.lit(".parquet")))
    return sources.payload_by_path(refs, sf, "*.parquet").select("r_regionkey", "name", "bytes", F.crc32("payload").alias("crc"), "error")


@query
def inline_payload(spark, sf):
    rows = sources.inline_payload(_vision(spark, sf).drop("error"))
    return rows.select("conv_id", "turn", "elem_pos", F.hex("payload").alias("payload"), "error")


@query
def remote_payload(spark, sf):
    rows = sources.remote_payload(_vision(spark, sf).drop("error"), table(spark, sf, "remote"))
    return rows.select("conv_id", "turn", "elem_pos", "uri", "payload", "error")


@query
def content_elements(spark, sf):
    return _elements(spark, sf).select("conv_id", "turn", "elem_pos", "type", F.array_join("keys", ",").alias("keys"))


@query
def vision_elements(spark, sf):
    return _vision(spark, sf).select("conv_id", "turn", "elem_pos", "type", "uri")


@query
def audio_elements(spark, sf):
    return C.audio_elements(_elements(spark, sf)).select("conv_id", "turn", "elem_pos", "uri", "error")


@query
def audio_refs_with_video(spark, sf):
    return C.audio_refs(_elements(spark, sf), _video_audio(spark, sf)).select("conv_id", "turn", "elem_pos", "source", "uri", "error")


@query
def uri_scheme_counts(spark, sf):
    return _vision(spark, sf).groupBy("modality", C.uri_scheme(F.col("uri")).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query
def media_by_modality(spark, sf):
    return _vision(spark, sf).select("conv_id", "turn", "elem_pos", "modality", "error")


@query
def masked_features(spark, sf):
    """Whole feature rows that a mask keeps; their sum stands for the vector."""
    rows = layout.masked_rows(table(spark, sf, "features").withColumn("mask", (F.col("vec_id") % 11 != 0).cast("int")))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("item", F.col("pos").cast("long").alias("pos"), "k", "vec_id", F.round(total, 6).alias("total"))


@query
def right_padding_check(spark, sf):
    return layout.right_padding(table(spark, sf, "tokens"))


def _catalog(spark, sf):
    return media.catalog(*(table(spark, sf, f"{kind}_meta") for kind in ("image", "video", "audio")))


def _planned(spark, sf):
    return media.plan_elements(table(spark, sf, "messages"), _catalog(spark, sf))


def _heard(spark, sf):
    """The feature rows that each sample's audios give."""
    tokens = E.audio_lengths(F.col("mel_len"))["tokens"]
    return table(spark, sf, "id_audios").select("sample_id", F.lit("audio").alias("modality"), F.explode(F.sequence(F.lit(1).cast("long"), tokens)).alias("k"))


@query
def quarantine_counts(spark, sf):
    found = [
        _planned(spark, sf).select("error"),
        layout.right_padding(table(spark, sf, "tokens")).select(F.when(F.col("right_padded"), "right_padding").alias("error")),
        joins.unknown_speakers(table(spark, sf, "requests"), table(spark, sf, "speakers")).select(F.lit("unknown_speaker").alias("error")),
        media.plan_frame_lists(table(spark, sf, "frame_lists"), table(spark, sf, "image_meta")).select("error"),
        layout.media_counts(_marked_tokens(spark, sf)).select("error"),
        joins.length_mismatch(table(spark, sf, "ids"), _heard(spark, sf), 90005, "audio").select(F.lit("audio_len_mismatch").alias("error")),
        mix.request_errors(table(spark, sf, "requests")).select("error"),
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.where("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def image_resize_plan(spark, sf):
    none = _none(resized_height="long", resized_width="long", min_pixels="long", max_pixels="long")
    return media.plan_images(table(spark, sf, "image_meta").withColumns(none)).select("image_id", "h", "w", "error")


def _planned_videos(spark, sf):
    none = _none(resized_height="long", resized_width="long", min_pixels="long", total_pixels="double", min_frames="double")
    return media.plan_videos(table(spark, sf, "video_meta").withColumns(none))


@query
def video_frame_count(spark, sf):
    return _planned_videos(spark, sf).select("video_id", "n", "sample_fps")


@query
def video_frame_samples(spark, sf):
    return media.sample_frames(_planned_videos(spark, sf))


@query
def video_resize_plan(spark, sf):
    return _planned_videos(spark, sf).select("video_id", _r("budget"), "h", "w", "error")


@query
def video_trim(spark, sf):
    rows = table(spark, sf, "frame_pts")
    start = F.when(F.col("video_id") % 3 != 0, (F.col("video_id") % 5).cast("double"))
    end = F.when(F.col("video_id") % 4 != 0, (F.col("video_id") % 5 + 2.5).cast("double"))
    return media.trim(rows, start, end)


@query
def frame_list_videos(spark, sf):
    rows = media.plan_frame_lists(table(spark, sf, "frame_lists"), table(spark, sf, "image_meta"))
    return rows.select("video_id", "n", F.array_join("frames", ",").alias("frames"), "h", "w", "fps", "error")


@query
def vision_token_counts(spark, sf):
    rows = _planned_videos(spark, sf).where("error IS NULL")
    return rows.select("video_id", media.planned_tokens(F.col("n"), F.col("h"), F.col("w")).alias("tokens"))


@query
def audio_token_counts(spark, sf):
    return table(spark, sf, "audio_meta").withColumn("a", E.audio_lengths(F.col("mel_len"))).select("audio_id", "a.frames", "a.tokens")


@query
def token_budget(spark, sf):
    return media.token_budget(_planned(spark, sf), 4096)


@query
def frame_lists_of_messages(spark, sf):
    """Videos that messages give as lists of frames, with the settings of their elements."""
    rows = _vision(spark, sf).where("frames IS NOT NULL").drop("error").select("*", F.posexplode_outer("frames").alias("frame_no", "frame"))
    rows = rows.withColumn("image_id", C.media_id(F.col("frame")))
    listed = media.plan_frame_lists(rows, table(spark, sf, "image_meta"), ["conv_id", "turn", "elem_pos"])
    return listed.select("conv_id", "turn", "elem_pos", "n", F.array_join("frames", ",").alias("frames"), "h", "w", "fps", "error")


@query
def planned_elements(spark, sf):
    return _planned(spark, sf).drop("sample_fps")


@query
def vision_flat(spark, sf):
    return media.vision_flat(_planned(spark, sf))


@query
def vision_result(spark, sf):
    rows = media.vision_result(_planned(spark, sf))
    sizes = lambda c, h, w: F.array_join(F.transform(c, lambda x: F.format_string("%dx%d", x[h], x[w])), ",")
    shown = {f"{short}_{name}_hw": sizes(c, *of) for short, c in (("img", "images"), ("video", "videos")) for name, of in (("resized", ("h", "w")), ("ori", ("height", "width")))}
    rates = F.array_join(F.transform("videos", lambda x: F.round(x["fps"] * 1000).cast("long")), ",")
    return rows.select("conv_id", *[v.alias(k) for k, v in shown.items()], rates.alias("milli_fps"))


@query
def audio_chunks(spark, sf):
    return layout.audio_chunks(table(spark, sf, "audio_meta"))


@query
def chunk_offsets(spark, sf):
    return layout.chunk_offsets(layout.audio_chunks(table(spark, sf, "audio_meta"))).select("audio_id", "chunk", "start", "stop")


def _grids(spark, sf):
    rows = table(spark, sf, "segments").where("kind IN ('image', 'video')")
    return rows.select((F.col("sample_id") * 1000 + F.col("seg_no")).alias("media_id"), "grid_t", "grid_h", "grid_w")


@query
def frame_offsets(spark, sf):
    return layout.frame_offsets(_grids(spark, sf))


@query
def spatial_tiles(spark, sf):
    return layout.spatial_tiles(_grids(spark, sf))


@query
def grid_coords(spark, sf):
    return layout.grid_coords(_grids(spark, sf))


@query
def permutation_roundtrip(spark, sf):
    tiles = layout.spatial_tiles(_grids(spark, sf))
    moved = tiles.select("media_id", "idx", (F.col("cell") * 7 + F.col("media_id")).alias("value"))
    return joins.undo_permutation(moved, tiles, "media_id").select("media_id", "cell", "value")


@query
def positions_text(spark, sf):
    return layout.positions_text(table(spark, sf, "tokens")).withColumn("pos", F.col("pos").cast("long"))


@query
def positions_multimodal(spark, sf):
    return layout.positions_multimodal(table(spark, sf, "segments"))


@query
def positions_from_ids(spark, sf):
    """Positions parsed out of raw ids; lengths that do not fit their rows (every 23rd sample's audios) are errors."""
    return positions.positions_from_ids(table(spark, sf, "ids"), table(spark, sf, "id_grids"), table(spark, sf, "id_audios"))


@query
def positions_audio_in_video(spark, sf):
    """The same where videos come with their audio between them."""
    return positions.positions_from_ids(table(spark, sf, "av_ids"), table(spark, sf, "id_grids"), table(spark, sf, "av_audios"), audio_in_video=True)


@query
def time_chunks(spark, sf):
    return layout.time_chunks(table(spark, sf, "timed")).withColumn("i", F.col("i").cast("long"))


@query
def av_interleave(spark, sf):
    rows = table(spark, sf, "timed").withColumn("i", F.col("i").cast("long"))
    video = rows.where("i % 2 = 0").select("item", F.floor(F.col("i") / 2.0).alias("i"), "t", (F.col("t") + 3).alias("m"))
    audio = rows.where("i % 2 = 1").select("item", F.floor(F.col("i") / 2.0).alias("i"), "t", F.col("t").alias("m"))
    return layout.interleave(video, audio)


def _marked_tokens(spark, sf):
    """Tokens in which the start of audio has an id of its own."""
    follows = F.lead("token_id").over(Window.partitionBy("sample_id").orderBy("pos"))
    rows = table(spark, sf, "tokens").withColumn("follows", follows)
    return rows.withColumn("token_id", F.when((F.col("token_id") == 90001) & (F.col("follows") == 90005), 90006).otherwise(F.col("token_id"))).drop("follows")


@query
def media_counts(spark, sf):
    return layout.media_counts(_marked_tokens(spark, sf))


@query
def visible_context(spark, sf):
    return layout.visible_context(table(spark, sf, "tokens"), 16).withColumn("pos", F.col("pos").cast("long"))


@query
def continuation_positions(spark, sf):
    return layout.continuation_positions(table(spark, sf, "steps").withColumn("batch", F.col("batch").cast("long")).withColumns({"delta": -(F.col("conv") % 5), "padded": F.col("conv") % 3}))


PLACEHOLDERS = {90003: "image", 90004: "video", 90005: "audio"}


@query
def placeholder_join(spark, sf):
    tokens = table(spark, sf, "tokens").select("sample_id", F.col("pos").cast("long").alias("pos"), F.col("token_id").cast("long").alias("token_id"))
    names = F.array(*[F.lit(n) for n in PLACEHOLDERS.values()])
    samples = tokens.select("sample_id").distinct()
    count = F.when(F.col("modality") == "audio", 40).otherwise(70)
    table_size = table(spark, sf, "embeddings").count()
    features = samples.select("sample_id", F.explode(names).alias("modality"))
    features = features.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("k")).withColumn("vec_id", (F.col("sample_id") * 13 + F.col("k")) % F.lit(table_size))
    vectors = table(spark, sf, "embeddings").select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x"))
    own = vectors.withColumnRenamed("vec_id", "own_id")
    tokens = tokens.withColumn("own_id", F.col("token_id") % F.lit(table_size)).join(own, "own_id").drop("own_id")
    return joins.placeholder_join(tokens, features.join(vectors, "vec_id"), PLACEHOLDERS)


@query
def speaker_lookup(spark, sf):
    return joins.speaker_lookup(table(spark, sf, "requests"), table(spark, sf, "speakers"))


@query
def unknown_speakers(spark, sf):
    return joins.unknown_speakers(table(spark, sf, "requests"), table(spark, sf, "speakers"))


@query
def segment_lookup(spark, sf):
    """Positions of all tokens in the segments that begin before them, both in rope positions."""
    starts = layout.segment_starts(table(spark, sf, "segments")).select("sample_id", "start", "seg_no")
    points = layout.positions_multimodal(table(spark, sf, "segments")).select("sample_id", "idx", F.col("t").alias("pos")).distinct()
    return joins.segment_lookup(points.select("sample_id", "pos").distinct(), starts)


@query
def interval_lookup(spark, sf):
    """Unpadded rows in the media around them, three rows more on either side, so these overlap and leave gaps."""
    order = Window.partitionBy("sample_id").orderBy("pos")
    points = table(spark, sf, "tokens").where("mask = 1").select("sample_id", (F.row_number().over(order) - 1).cast("long").alias("pos"))
    offset = F.sum("len").over(Window.partitionBy("sample_id").orderBy("seg_no")) - F.col("len")
    held = table(spark, sf, "segments").withColumn("offset", offset).where("kind IN ('image', 'video', 'audio')")
    return joins.interval_lookup(points, held.select("sample_id", (F.col("offset") - 3).alias("start"), (F.col("offset") + F.col("len") + 3).alias("stop"), F.col("seg_no").cast("long").alias("seg_no")))


@query
def block_band_join(spark, sf):
    rows = table(spark, sf, "codes").select("item", F.col("pos").cast("long").alias("pos"))
    return joins.block_band_join(rows, rows, "item", 2, back=1, ahead=0)


@query
def clamped_zip(spark, sf):
    steps = table(spark, sf, "steps").select("conv", F.col("batch").cast("long").alias("step"))
    replies = table(spark, sf, "steps").where("batch < 5 + conv % 7").select("conv", F.col("batch").cast("long").alias("idx"), F.col("event_id").alias("reply"))
    return joins.clamped_zip(steps, replies)


@query
def valid_lengths(spark, sf):
    return pool.valid_lengths(table(spark, sf, "tokens"))


def _pooled(spark, sf):
    return table(spark, sf, "features")


@query
def pair_pooling(spark, sf):
    return pool.pair_pooling(_pooled(spark, sf)).select("item", "pair", "dim", _r("value"))


@query
def stats_pooling(spark, sf):
    rows = _pooled(spark, sf)
    soft = pool.stats_pooling(rows, softmax_of=F.element_at("vec", 1)).select("item", "dim", F.col("mean").alias("soft_mean"), F.col("std").alias("soft_std"))
    return pool.stats_pooling(rows).join(soft, ["item", "dim"]).select("item", "dim", _r("mean"), _r("std"), _r("soft_mean"), _r("soft_std"))


@query
def masked_nll(spark, sf):
    rows = _pooled(spark, sf).select("item", "pos", F.when(F.col("vec_id") % 9 == 0, -100).otherwise(F.col("vec_id") % 64).alias("label"), F.when(F.col("vec_id") % 11 == 0, 0).otherwise(1).alias("mask"), F.col("vec").alias("logits"))
    return pool.masked_nll(rows).select(_r("loss"), "n")


@query
def padding_plan(spark, sf):
    rows = pool.padding_plan(layout.audio_chunks(table(spark, sf, "audio_meta")))
    return rows.select("audio_id", "width", "chunks", "kept", "kept_half", _r("waste"))


def _id_lists(spark, sf):
    one = F.sort_array(F.collect_list(F.struct("pos", "code")))
    return table(spark, sf, "codes").groupBy("item").agg(one.alias("x")).select("item", F.col("x.code").alias("ids"))


@query
def completion_slice(spark, sf):
    rows = _id_lists(spark, sf)
    cut = lambda k: F.array_join(layout.completion(F.col("ids"), F.col("item") % 4, k), ",")
    return rows.select("item", cut(0).alias("text"), cut(1).alias("codec"))


@query
def talker_inputs(spark, sf):
    rows = _id_lists(spark, sf).select(F.col("item").alias("sample_id"), F.col("ids").alias("prompt"), (F.col("item") * 3).alias("first_reply"))
    rows = layout.talker_inputs(rows, F.lit(1007).cast("long"), 8292, 8293, 8294)
    return rows.select("sample_id", *[F.array_join(c, ",").alias(c) for c in ("ids", "codes", "mask")])


@query
def offsets_dedup(spark, sf):
    rows = table(spark, sf, "timed").withColumn("i", F.col("i").cast("long"))
    return layout.offsets_dedup(rows, "item", "i", "t").select("item", "i", "t")


@query
def rollout_fanout(spark, sf):
    return layout.fan_out(table(spark, sf, "conversations").select("conv_id").distinct(), 8)


@query
def rollout_media_fanout(spark, sf):
    rows = table(spark, sf, "segments").where("kind IN ('image', 'video', 'audio')").select("sample_id", "seg_no", "kind")
    order = Window.partitionBy("sample_id").orderBy("g", "seg_no")
    return layout.fan_out(rows, 4).select("sample_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "g", "kind")


@query
def codec_repeat(spark, sf):
    return layout.codec_repeat(table(spark, sf, "codes"), 2)


def _vectors(spark, sf, name, values):
    rows = table(spark, sf, "embeddings").select("vec_id", values(F.transform("embedding", lambda x: x.cast("double") * 10)).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("dim", name)).select("vec_id", F.col("dim").cast("long").alias("dim"), _r(name))


@query
def mel_to_db(spark, sf):
    return _vectors(spark, sf, "db", E.mel_to_db)


@query
def clamp_unit(spark, sf):
    return _vectors(spark, sf, "x", E.clamp_unit)


@query
def sinusoid_features(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(E.sinusoids(F.col("p_size"), 16)).alias("dim", "x"))
    return rows.select("p_partkey", F.col("dim").cast("long").alias("dim"), _r("x"))


@query
def param_routing(spark, sf):
    key = F.col("c_custkey")
    pairs = [("thinker_top_k", 2), ("talker_top_k", 3), ("token2wav_steps", 5), ("max_new_tokens", 7), ("attention_mask", 4)]
    entries = F.filter(F.array(*[F.struct(F.when(key % m == 0, k).alias("key"), (key % (m + 90)).cast("string").alias("value")) for k, m in pairs]), lambda e: e["key"].isNotNull())
    rows = table(spark, sf, "customer").select("c_custkey", F.map_from_entries(entries).alias("p"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select(
        "c_custkey",
        shown(mix.route_params(F.col("p"), "thinker_", {"max_new_tokens": "1024"}, first=True)).alias("thinker"),
        shown(mix.route_params(F.col("p"), "talker_", {"max_new_tokens": "4096", "top_k": "40"})).alias("talker"),
        shown(mix.route_params(F.col("p"), "token2wav_")).alias("token2wav"),
    )


@query
def strip_special(spark, sf):
    rows = _id_lists(spark, sf)
    ids = F.transform("ids", lambda x: x % 10)
    return rows.select("item", F.array_join(layout.strip_special(ids, [0, 3, 7]), ",").alias("ids"))


@query
def linear_resample(spark, sf):
    return joins.linear_resample(table(spark, sf, "series"), 21600.0).select("item", "grid", _r("value"))


@query
def training_mix(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset"))
    return mix.training_mix(rows, {"en": 100, "de": 40, "en_multi": 30}, multi=F.col("doc_id") % 7 == 0, use_multi=True)


@query
def length_limits(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", F.col("n_chars").alias("prompt_tokens"), (F.col("n_chars") * 3).alias("completion_tokens"))
    return mix.length_limits(rows, 2000)


def _rewarded(spark, sf):
    return table(spark, sf, "rollouts").withColumn("reward", mix.reward())


@query
def reward_sum(spark, sf):
    return _rewarded(spark, sf).select("event_id", _r("reward"))


@query
def group_advantage(spark, sf):
    return mix.group_advantage(_rewarded(spark, sf), "prompt", "grp").select("event_id", F.round("advantage", 4).alias("advantage"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


SLICES = 3


def _slices(spark, sf, processor, replies: bool = False) -> DataFrame:
    """Events in SLICES runs by id, each a micro-batch of its own; what a processor keeps is carried from run to run."""
    rows = table(spark, sf, "events")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    at = F.floor((F.col("event_id") - F.lit(low)) * SLICES / F.lit((high or 0) - (low or 0) + 1))
    none = _none(reply="long", final="boolean")
    steps = rows.select(F.col("user_id").alias("conv"), F.col("event_id").alias("batch"), (1 + F.floor("value") % 20).cast("long").alias("len"), (-(F.col("user_id") % 5)).cast("long").alias("delta"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("media"), *[v.alias(k) for k, v in none.items()], at.alias("at"))
    # the replies of a conversation, by the rows of its first events, some of them a run later than their steps
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    come = F.least(at + F.col("user_id") % 2, F.lit(SLICES - 1))
    told = rows.withColumn("k", k).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("k < 5 + user_id % 7")
    told = told.select(F.col("user_id").alias("conv"), F.col("event_id").alias("batch"), *[v.alias(c) for c, v in _none(len="long", delta="long", media="string").items()], (F.col("event_id") * 10).alias("reply"), (F.col("k") == F.least(F.col("n") - 1, 4 + F.col("user_id") % 7)).alias("final"), come.alias("at"))
    rows = steps.unionByName(told) if replies else steps
    out = _folder(spark, "stream")
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        for k in range(SLICES):
            rows.where(F.col("at") == k).drop("at").write.mode("append").parquet(f"{out}/in")
            stream = spark.readStream.schema(rows.drop("at").schema).parquet(f"{out}/in")
            state.run_available(processor(stream), f"{out}/data", f"{out}/state")
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{out}/data")


@query
def stream_positions(spark, sf):
    return _slices(spark, sf, state.stream_positions)


@query
def stream_reply_zip(spark, sf):
    return _slices(spark, sf, state.stream_reply_zip, replies=True)


def _planned_stream(spark, sf) -> DataFrame:
    """Messages as a stream of files, each micro-batch planned with the static catalogs into its own folder."""
    out = _folder(spark, "stream")
    messages = table(spark, sf, "messages")
    messages.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    catalogs = _catalog(spark, sf)
    state.plan_stream(stream, lambda m: media.plan_elements(m, catalogs), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").drop("epoch")


@query
def stream_media_plan(spark, sf):
    return _planned_stream(spark, sf).drop("sample_fps")


@query
def stream_token_budget(spark, sf):
    """Budgets over all epochs: those of :func:`token_budget`, however the stream was cut."""
    return media.token_budget(_planned_stream(spark, sf), 4096)


def echo_model(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A stand-in for a model: two ids that follow from the unpadded prompt."""
    total = (ids * mask).sum(axis=1, keepdims=True)
    return np.hstack([ids, total % 1000 + 5, mask.sum(axis=1, keepdims=True) + 3])


def load_echo() -> infer.Model:
    """Loads the model; called once in a worker."""
    return echo_model


@query
def batch_inference(spark, sf):
    prompts = _id_lists(spark, sf).select(F.col("item").alias("sample_id"), "ids")
    return infer.batch_inference(prompts, load_echo, special=(4,)).select("sample_id", F.array_join("completion", ",").alias("completion"))


@query
def conversation_inference(spark, sf):
    """From messages over the plan to completions: texts as ids, media as the placeholders that their plans call for."""
    texts = C.elements(table(spark, sf, "messages"), plain=True).select("conv_id", "turn", "elem_pos", F.length("text").alias("chars"))
    planned = _planned(spark, sf).where("error IS NULL AND tokens > 0").join(texts, ["conv_id", "turn", "elem_pos"])
    return infer.batch_inference(infer.prompts(planned), load_echo, special=(4,)).select("sample_id", F.array_join("completion", ",").alias("completion"))
