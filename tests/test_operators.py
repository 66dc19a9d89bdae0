"""Hand-worked rows, properties, and batch against stream."""

import random
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import content as C
from tessera.operators import infer, joins, layout, media, mix, pool
from tessera.plans.fixtures import table
from tessera.plans.queries import QUERIES, load_echo
from tessera.sources import media as sources
from tessera.streaming import state


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bounds,size,want", [
    (E.IMAGE_PIXELS, (1080, 1920), (812, 1484, None)), (E.FRAME_PIXELS, (1080, 1920), (224, 420, None)), (E.IMAGE_PIXELS, (28, 28), (224, 224, None)),
    (E.IMAGE_PIXELS, (42, 42), (224, 224, None)), (E.FRAME_PIXELS, (28, 5600), (0, 4480, "zero_side")), (E.IMAGE_PIXELS, (10, 2001), (None, None, "ratio")), (E.IMAGE_PIXELS, (0, 5), (None, None, "ratio")),
])
def test_resize(spark, bounds, size, want):
    assert tuple(one(spark, E.smart_resize(F.col("h"), F.col("w"), *bounds), h=size[0], w=size[1])) == want


@pytest.mark.parametrize("mel,want", [(0, (0, 0)), (1, (1, 0)), (2, (1, 0)), (200, (100, 50))])
def test_audio_lengths(spark, mel, want):
    assert tuple(one(spark, E.audio_lengths(F.col("m")), m=mel)) == want


def test_time_chunks(spark):
    rows = [(0, i, t) for i, t in enumerate([0, 0, 50, 50, 50, 50])]
    rng = random.Random(3)
    for item in range(1, 40):
        t = 0
        for i in range(30):
            rows.append((item, i, t))
            t += rng.choice([0, 1, 3, 12, 45])
    got = {(r.item, r.i): r.chunk for r in layout.time_chunks(spark.createDataFrame(rows, "item long, i long, t long"), 10).collect()}
    assert [got[0, i] for i in range(6)] == [0, 0, 1, 2, 3, 4]
    cuts = {}
    for item, i, t in rows:
        cuts[item] = 0 if i == 0 else cuts[item] + (t >= (cuts[item] + 1) * 10)
        assert got[item, i] == cuts[item]


def test_positions(spark):
    segs = [(0, 0, "video", 12, 3, 4, 4, 2.0), (0, 1, "text", 5, 0, 0, 0, 0.0)]
    got = layout.positions_multimodal(spark.createDataFrame(segs, "sample_id long, seg_no long, kind string, len long, grid_t long, grid_h long, grid_w long, sec double")).orderBy("idx").collect()
    assert [r.t for r in got] == [0] * 4 + [50] * 4 + [100] * 4 + [101, 102, 103, 104, 105]
    for mask, want, delta in (([0, 0, 1, 1, 1], [1, 1, 0, 1, 2], 0), ([0, 0, 1], [1, 1, 0], 1)):
        rows = layout.positions_text(spark.createDataFrame([(1, i, m) for i, m in enumerate(mask)], "sample_id long, pos long, mask int")).orderBy("pos").collect()
        assert [r.position for r in rows] == want and rows[0].delta == delta


def test_plans_keep_their_bounds(spark, sf):
    videos = QUERIES["video_frame_samples"](spark, sf).groupBy("video_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n"))
    meta = table(spark, sf, "video_meta")
    bad = videos.join(meta, "video_id").where("a <> 0 OR b <> total_frames - 1 OR n % 2 = 1 OR n > 768")
    assert bad.count() == 0
    assert QUERIES["image_resize_plan"](spark, sf).where("error IS NULL AND (h % 28 <> 0 OR w % 28 <> 0 OR h * w > 1254400)").count() == 0


def test_partition_count_does_not_matter(spark, sf):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return [sorted(map(tuple, QUERIES[q](spark, sf).collect())) for q in ("positions_multimodal", "av_interleave", "segment_lookup")]

    try:
        assert run(1) == run(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_streams_match_batches(spark, sf):
    steps = table(spark, sf, "steps")
    key = steps.select("conv", F.col("batch").alias("k"), F.col("event_id").alias("batch"))
    want = QUERIES["continuation_positions"](spark, sf).withColumnRenamed("batch", "k").join(key, ["conv", "k"]).select("conv", "batch", "i", "position")
    assert sorted(map(tuple, QUERIES["stream_positions"](spark, sf).drop("media").collect())) == sorted(map(tuple, want.collect()))
    zipped = {(r.conv, r.step): r.idx for r in QUERIES["clamped_zip"](spark, sf).collect()}
    ids = {(r.conv, r.k): r.batch for r in key.collect()}
    got = {(r.conv, r.step): r.reply for r in QUERIES["stream_reply_zip"](spark, sf).collect()}
    assert got == {(conv, step): 10 * ids[conv, idx] for (conv, step), idx in zipped.items()}
    for stream, batch in (("stream_media_plan", "planned_elements"), ("stream_token_budget", "token_budget")):
        assert sorted(map(repr, QUERIES[batch](spark, sf).collect())) == sorted(map(repr, QUERIES[stream](spark, sf).collect()))


def test_continuation_over_three_runs(spark, tmp_path):
    """Steps before their replies, replies in later runs, the last one for ever, media on the first batch alone."""
    schema = "conv long, batch long, len long, delta long, media string, reply long, final boolean"
    step = lambda c, b, n=2: (c, b, n, -3, f"m{b}", None, None)
    told = lambda c, b, r, last=False: (c, b, None, None, None, r, last)
    runs = [[step(1, 1), step(1, 2), step(2, 1), told(2, 0, 70), told(2, 1, 71)], [step(1, 3), told(1, 9, 50), step(2, 2), step(2, 3)], [told(1, 10, 51, True), step(1, 4), told(2, 5, 72, True), step(2, 4)]]
    seen = []
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for name, form in (("zip", state.stream_reply_zip), ("pos", state.stream_positions)):
            stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
            stream = stream.where("reply IS NULL") if name == "pos" else stream
            state.run_available(form(stream), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state")
        seen.append({tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/zip").collect()})
    assert seen[0] == {(2, 1, 0, 70)}
    assert seen[1] - seen[0] == {(1, 1, 0, 50), (2, 2, 1, 71)}
    assert seen[2] - seen[1] == {(1, 2, 1, 51), (1, 3, 2, 51), (1, 4, 3, 51), (2, 3, 2, 72), (2, 4, 3, 72)}
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/pos").where("conv = 1").collect()))
    assert got == [(1, b, i, -3 + 2 * (b - 1) + i, "m1" if b == 1 else None) for b in (1, 2, 3, 4) for i in (0, 1)]


def test_a_replayed_epoch_changes_nothing(spark, sf, tmp_path):
    messages, catalogs = table(spark, sf, "messages"), media.catalog(*(table(spark, sf, f"{k}_meta") for k in ("image", "video", "audio")))
    where = f"file://{tmp_path}"
    messages.repartition(2).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    plan = lambda m: media.plan_elements(m, catalogs)
    state.plan_stream(stream, plan, f"{where}/data", f"{where}/state")
    rows = lambda: sorted(map(repr, spark.read.parquet(f"{where}/data").collect()))
    before = rows()
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the driver had died after the sink and before the commit
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    state.plan_stream(stream, plan, f"{where}/data", f"{where}/state")
    assert rows() == before and len(before) > 50


def test_planning_reads_messages_once(spark, sf):
    plan = QUERIES["token_budget"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conversations.parquet") <= 1 and plan.count("from_json") == 1


def test_planners_fail_strictly(spark, sf):
    catalogs = media.catalog(*(table(spark, sf, f"{k}_meta") for k in ("image", "video", "audio")))
    with pytest.raises(Exception, match="no_media_key|no_audio_track|not_in_catalog|image_unrecognised|frame_sizes_differ|audio_not_mono"):
        media.plan_elements(table(spark, sf, "messages"), catalogs, strict=True).collect()


def test_quarantine_writes_rows_by_code_and_counts_them(spark, sf, tmp_path):
    planned = QUERIES["planned_elements"](spark, sf)
    counts = sources.write_quarantined(planned, f"file://{tmp_path}/q")
    want = {r.error: r["count"] for r in planned.where("error IS NOT NULL").groupBy("error").count().collect()}
    assert {k: v for k, v in counts.items() if v} == want and set(counts) == set(sources.CODES)
    assert spark.read.parquet(f"file://{tmp_path}/q").where("kept = 'good' AND error IS NOT NULL").count() == 0
    bad = spark.read.parquet(f"file://{tmp_path}/q").where("kept = 'bad'")
    assert {r.code: r["count"] for r in bad.groupBy("code").count().collect()} == want


def test_a_user_element_inherits_to_frames_and_lists_may_be_empty(spark):
    content = """[{"type":"video","video":["/f/1.jpg","/f/2.jpg","/f/1.jpg"],"resized_height":280,"resized_width":280},{"type":"video","video":[]},
        {"type":"video","video":["/f/1.jpg","/f/2.jpg"]},{"type":"video","video":"/v/9.mp4","fps":1.0},{"type":"text","text":"abcde","image":"/i/1.png","min_pixels":100352}]"""
    messages = spark.createDataFrame([(1, 0, "user", content), (1, 1, "user", "plain"), (1, 2, "user", "[broken"), (1, 3, "user", None)], "conv_id long, turn long, role string, content string")
    images = spark.createDataFrame([(1, 100, 100), (2, 400, 100)], "image_id long, height int, width int")
    videos = spark.createDataFrame([(9, 300, 30.0, 360, 640, True)], "video_id long, total_frames long, video_fps double, height int, width int, has_audio boolean")
    audios = spark.createDataFrame([], "audio_id long, mel_len long")
    got = {(r.turn, r.elem_pos, r.role): (r.modality, r.n, r.h, r.w, r.error) for r in media.plan_elements(messages, media.catalog(images, videos, audios)).collect()}
    assert got[0, 0, "vision"] == ("video", 4, 280, 280, None)
    assert got[0, 1, "vision"] == ("video", 0, None, None, "frame_sizes_differ") and got[0, 2, "vision"][4] == "frame_sizes_differ"
    assert got[0, 3, "vision"] == ("video", 10, 224, 420, None) and got[0, 3, "track"][4] is None and got[0, 0, "track"][4] == "no_audio_track"
    assert got[0, 4, "vision"] == ("image", None, 336, 336, None) and got[0, 4, "text"][0] == got[1, 0, "text"][0] == "text"
    assert {k[0] for k in got} == {0, 1}


def test_intervals_with_gaps_and_overlaps(spark):
    rng = random.Random(9)
    points = [(k, rng.randint(-50, 400)) for k in (1, 2) for _ in range(200)]
    intervals = [(k, a, a + rng.choice([0, 1, 7, 64, 200]), n) for n, (k, a) in enumerate((rng.choice([1, 2, 3]), rng.randint(-40, 380)) for _ in range(30))]
    got = joins.interval_lookup(spark.createDataFrame(points, "sample_id long, pos long"), spark.createDataFrame(intervals, "sample_id long, start long, stop long, seg long")).collect()
    want = []
    for k, p in points:
        held = [(k, p, a, b, n) for j, a, b, n in intervals if j == k and a <= p < b]
        want += held or [(k, p, None, None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_batches_of_like_length_over_the_whole_table(spark):
    rng = random.Random(4)
    rows = [(i, [1 + i % 90] * rng.choice([1, 2, 3, 50, 51, 400])) for i in range(600)]
    prompts = spark.createDataFrame(rows, "sample_id long, ids array<long>").repartition(7)
    done = infer.batch_inference(prompts, load_echo, batch=16)
    got = {r.sample_id: r.completion for r in done.collect()}
    assert got == {i: [(sum(ids)) % 1000 + 5, len(ids) + 3] for i, ids in rows}
    share = infer.padding_share(done).first().share
    by_order = [rows[k : k + 16] for k in range(0, 600, 16)]
    plain = sum(max(len(x) for _, x in b) * len(b) - sum(len(x) for _, x in b) for b in by_order) / sum(max(len(x) for _, x in b) * len(b) for b in by_order)
    assert share < plain / 3
    assert infer.batch_inference(prompts, load_echo, batch=64, batch_tokens=1000).where("width > 400").count() == 0


def test_batches_go_to_spark_in_few_frames(spark, monkeypatch):
    """A task gives back many batches in one frame, and a new one only after so many ids."""
    rows = [(i, [1 + i % 9] * (1 + i % 5)) for i in range(2000)]
    prompts, tasks = spark.createDataFrame(rows, "sample_id long, ids array<long>"), []
    monkeypatch.setattr(type(prompts), "mapInPandas", lambda self, run, kind: tasks.append(run) or self.selectExpr("sample_id", "ids AS out", "1 AS n", "1 AS width"))
    infer.batch_inference(prompts, load_echo, batch=8)
    parts = [pd.DataFrame(rows[k : k + 500], columns=["sample_id", "ids"]) for k in range(0, 2000, 500)]
    for most, frames in ((infer.FRAME_TOKENS, [2000]), (1, [8] * 250)):
        monkeypatch.setattr(infer, "FRAME_TOKENS", most)
        made = list(tasks[0](iter(parts)))
        assert [len(f) for f in made] == frames
        got = [(r.sample_id, list(r.out[r.width :]), r.n) for f in made for r in f.itertuples()]
        assert got == [(i, [sum(ids) % 1000 + 5, len(ids) + 3], len(ids)) for i, ids in rows]


def test_batch_inference(spark, sf):
    got = QUERIES["batch_inference"](spark, sf).collect()
    lists = {}
    for r in table(spark, sf, "codes").orderBy("item", "pos").collect():
        lists.setdefault(r.item, []).append(r.code)
    for r in got:
        own = lists[r.sample_id]
        want = [x for x in (sum(own) % 1000 + 5, len(own) + 3) if x not in (0, 4)]
        assert r.completion == ",".join(map(str, want))
    assert len(got) == len(lists)
    with pytest.raises(ValueError):
        infer.batch_inference(None, lambda a, b: a, speech=True)


def test_payloads_and_sink(spark, sf, tmp_path):
    rows = QUERIES["payload_by_path"](spark, sf).collect()
    assert {r.name for r in rows if r.error} == {"missing"}
    held = {n: Path(f"{sf}/{n}.parquet").read_bytes() for n in ("region", "nation", "customer")}
    assert all((r.bytes, r.crc) == (len(held[r.name]), zlib.crc32(held[r.name])) for r in rows if not r.error)
    # only what is named is read; beyond a bound the folder is joined, with equal results
    odd = tmp_path / "files"
    odd.mkdir()
    for name in ("a[1].bin", "b{x}.bin", "c.bin", "d*.bin"):
        (odd / name).write_bytes(name.encode() * 3)
    refs = spark.createDataFrame([(f"file://{odd}/a[1].bin",), (f"{odd}/b{{x}}.bin",), (f"{odd}/none.bin",)], "uri string")
    named = sources.referenced_files(refs.withColumn("path", sources.local_path(F.col("uri"))), f"file://{odd}")
    assert len(named.inputFiles()) == 2
    for most in (10, 1):
        got = {r.uri: (r.bytes, bytes(r.payload) if r.payload else None, r.error) for r in sources.payload_by_path(refs, f"file://{odd}", most=most).collect()}
        assert got == {f"file://{odd}/a[1].bin": (24, b"a[1].bin" * 3, None), f"{odd}/b{{x}}.bin": (24, b"b{x}.bin" * 3, None), f"{odd}/none.bin": (None, None, "no_file")}
    media_rows = QUERIES["media_by_modality"](spark, sf).where("modality IS NOT NULL")
    sources.write_by_modality(media_rows, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == media_rows.count()


def test_groups_of_one_and_empty(spark):
    one_row = spark.createDataFrame([(1, 5.0)], "p long, reward double")
    assert mix.group_advantage(one_row, "p").first().advantage == 0
    empty = spark.createDataFrame([], "item long, pos long, vec array<float>")
    assert pool.pair_pooling(empty).count() == 0 and pool.stats_pooling(empty).count() == 0
    assert layout.audio_chunks(spark.createDataFrame([(1, 0)], "audio_id long, mel_len long")).count() == 0


def test_length_mismatch(spark):
    tokens = spark.createDataFrame([(1, 0, 9), (1, 1, 9), (2, 0, 9)], "sample_id long, pos long, token_id long")
    features = spark.createDataFrame([(1, "audio", 0), (2, "audio", 0)], "sample_id long, modality string, k long")
    assert [tuple(r) for r in joins.length_mismatch(tokens, features, 9, "audio").collect()] == [(1, 2, 1)]


def test_pad_right(spark):
    row = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert row.select(pool.pad_right(F.col("v"), F.lit(4)).alias("x")).first().x == [1.0, 2.0, 0.0, 0.0]
    assert np.allclose(row.select(E.sinusoids(F.lit(0), 4).alias("x")).first().x, [0, 0, 1, 1])
    with pytest.raises(ValueError):
        E.sinusoids(F.lit(0), 3)


def test_plan_of_the_flagship_prunes(spark, sf):
    plan = QUERIES["image_resize_plan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan and "BatchEvalPython" not in plan
    assert media.MAX_PROMPT_TOKENS == 32768


def test_strict_fails_with_the_code(spark):
    rows = spark.createDataFrame([(1, None), (2, "ratio")], "id long, error string")
    assert C.checked(rows).where("error = 'ratio'").count() == 1
    assert C.checked(rows.where("id = 1"), strict=True).count() == 1
    with pytest.raises(Exception, match="ratio"):
        C.checked(rows, strict=True).collect()


def test_audio_mode_of_media_counts(spark):
    start, heard, image, video = 90001, 90006, 90003, 90004
    samples = {1: [start, image, image, 5], 2: [heard, 90005, start, video, video], 3: [heard, start, image, start, image], 4: [heard, start, image, video], 5: [image, 7, start], 6: [heard, 90005]}
    rows = [(s, p, t) for s, ts in samples.items() for p, t in enumerate(ts)]
    got = {r.sample_id: tuple(r)[1:] for r in layout.media_counts(spark.createDataFrame(rows, "sample_id long, pos long, token_id long")).collect()}
    assert got == {1: (1, 0, 0, None), 2: (0, 1, 1, None), 3: (2, 0, 1, "vision_mix"), 4: (1, 1, 1, "vision_mix"), 5: (1, 0, 0, None), 6: (0, 0, 1, "vision_mix")}


def test_numbers_of_a_sample_that_holds_most_rows(spark):
    """Two levels of numbering equal one, and no task numbers more than a chunk."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 20), p, rng.choice("ab")) for p in range(5000)]
    rows = [(s, p, m) for s, p, m in rows]
    got = joins.numbered(spark.createDataFrame(rows, "sample_id long, pos long, modality string").repartition(5), ["sample_id", "modality"], chunk_rows=100).collect()
    seen, want = {}, set()
    for s, p, m in sorted(rows, key=lambda r: r[1]):
        want.add((s, p, m, seen.setdefault((s, m), 0)))
        seen[s, m] += 1
    assert {(r.sample_id, r.pos, r.modality, r.k) for r in got} == want and len(got) == len(rows)
    plan = joins.placeholder_join(*(spark.createDataFrame([(1, 1, 9)], f"sample_id long, pos long, {c} long") for c in ("token_id",)), spark.createDataFrame([(1, "a", 0, 5)], "sample_id long, modality string, k long, vec_id long"), {9: "a"})
    assert [tuple(r) for r in plan.collect()] == [(1, 1, 9, "a", 0, 5)]


def test_mix_takes_all_caps_in_one_pass(spark):
    rows = spark.createDataFrame([(i, f"d{i % 4}", i % 5 == 0) for i in range(2000)], "doc_id long, dataset string, several boolean")
    got = {r.dataset: r["count"] for r in mix.training_mix(rows, {"d0": 10, "d1": 7, "d2": 0, "none": 5}, multi=F.col("several")).groupBy("dataset").count().collect()}
    assert got == {"d0": 10, "d1": 7, "d3": 400}
    both = mix.training_mix(rows, {"d0": 10, "d3_multi": 3}, multi=F.col("several"), use_multi=True)
    assert {r.dataset: r["count"] for r in both.groupBy("dataset").count().collect()} == {"d0": 10, "d1": 400, "d2": 400, "d3": 400, "d0_multi": 100, "d1_multi": 100, "d2_multi": 100, "d3_multi": 3}
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_what_is_broadcast_is_small_in_rows_and_bytes(spark):
    rows = spark.createDataFrame([(str(i) * 50, i) for i in range(100)], "name string, n long")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(joins.small(rows)) and not hinted(joins.small(rows, rows=99)) and not hinted(joins.small(rows, size=5000))
    assert not hinted(joins.small(rows.select(F.array("n").alias("a")))) and hinted(joins.small(rows.limit(0)))
