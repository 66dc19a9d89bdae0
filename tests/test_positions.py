"""Positions from raw ids against a reader that walks each sample."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import positions
from tessera.operators.positions import positions_from_ids

VS, AS, EOS, IMG, VID, AUD = 90001, 90006, 90002, 90003, 90004, 90005


def chunks(t, n):
    cut, at, k = [0], 1, 1
    for i in range(len(t)):
        if t[i] >= k * n:
            cut.append(i)
            k += 1
    return [range(a, b) for a, b in zip(cut, [*cut[1:], len(t)])]


def walk(parts, paired, clock=25):
    """Rows of three positions from (kind, ...) parts, and the next free position after them."""
    out, start = [], 0

    def text(n):
        nonlocal start
        out.extend([(start + i,) * 3 for i in range(n)])
        start += n

    def vision(gt, gh, gw, sec):
        t = [int(np.float32(i) * np.float32(sec) * np.float32(clock)) for i in range(gt)]
        return [(t[i], y, x) for i in range(gt) for y in range(gh // 2) for x in range(gw // 2)]

    for kind, *how in parts:
        if kind == "text":
            text(how[0])
            continue
        if kind == "av" and paired:
            out.extend([(start,) * 3] * 2)
            start += 1
            rows, heard = vision(*how[:4]), [(i, i, i) for i in range(how[4])]
            v, a = chunks([r[0] for r in rows], 50), chunks([r[0] for r in heard], 50)
            for j in range(max(len(v), len(a))):
                for own, cut in ((rows, v), (heard, a)):
                    if j < len(cut) and len(cut[j]):
                        last = [own[i] for i in cut[j]]
                        out.extend(tuple(start + x for x in r) for r in last)
            start += max(max(r) for r in last) + 1
            out.extend([(start,) * 3] * 2)
            start += 1
            continue
        text(1)
        rows = [(i, i, i) for i in range(how[0])] if kind == "audio" else vision(*how)
        out.extend(tuple(start + x for x in r) for r in rows)
        start += max(max(r) for r in rows) + 1
        text(1)
    return out


def ids_of(parts):
    ids = []
    for kind, *how in parts:
        if kind == "text":
            ids += [7] * how[0]
        elif kind == "audio":
            ids += [AS] + [AUD] * how[0] + [EOS]
        else:
            n = how[0] * (how[1] // 2) * (how[2] // 2)
            ids += [VS] + ([AS] if kind == "av" else []) + [IMG if kind == "image" else VID] * n + ([AUD] * how[4] + [EOS] if kind == "av" else []) + [EOS]
    return ids


def tables(spark, samples):
    tokens, grids, audios = [], [], []
    for s, (left, parts, right) in samples.items():
        ids = ids_of(parts)
        tokens += [(s, p, t, m) for p, (t, m) in enumerate([(0, 0)] * left + [(t, 1) for t in ids] + [(0, 0)] * right)]
        for name in ("image", "video"):
            own = [how for kind, *how in parts if kind == name or (kind == "av" and name == "video")]
            grids += [(s, name, k, *how[:3], None if name == "image" else float(how[3])) for k, how in enumerate(own)]
        heard = [how[-1] for kind, *how in parts if kind in ("audio", "av")]
        audios += [(s, k, 4 * n) for k, n in enumerate(heard)]
    return (
        spark.createDataFrame(tokens, "sample_id long, pos long, token_id long, mask int").repartition(3),
        spark.createDataFrame(grids, "sample_id long, modality string, k long, grid_t long, grid_h long, grid_w long, sec double"),
        spark.createDataFrame(audios, "sample_id long, k long, mel_len long"),
    )


def placed(spark, samples, paired=False):
    got = {}
    for r in positions_from_ids(*tables(spark, samples), audio_in_video=paired).collect():
        got[r.sample_id, r.pos] = (r.t, r.h, r.w, r.delta, r.error)
    return got


def expected(samples, paired):
    want = {}
    for s, (left, parts, right) in samples.items():
        rows = walk(parts, paired)
        delta = max(map(max, rows)) + 1 - len(rows)
        for p, r in enumerate([(1, 1, 1)] * left + rows + [(1, 1, 1)] * right):
            want[s, p] = (*r, delta, None)
    return want


def test_documented_examples(spark):
    # a video of three steps of 2 x 2 cells, two seconds each, then text
    got = placed(spark, {1: (0, [("text", 0), ("video", 3, 4, 4, 2.0), ("text", 4)], 0)})
    assert [got[1, p][0] for p in range(18)] == [0] + [1] * 4 + [51] * 4 + [101] * 4 + [102 + i for i in range(5)]
    assert [got[1, p][1:3] for p in range(1, 5)] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    # video at 0 and 80, 60 audio rows, chunks of 50: the next start is one past the audio's end, below the video's
    got = placed(spark, {1: (0, [("av", 2, 2, 2, 3.2, 60), ("text", 1)], 0)}, paired=True)
    t = [got[1, p][0] for p in range(67)]
    assert t[:3] == [0, 0, 1] and t[3:53] == list(range(1, 51)) and t[53] == 81 and t[54:64] == list(range(51, 61)) and t[64:] == [61, 61, 62]
    assert got[1, 0][3] == 82 - 67


@pytest.mark.parametrize("paired", [False, True])
def test_equals_a_walk(spark, paired):
    rng = random.Random(paired)
    samples = {}
    for s in range(40):
        parts = [("text", rng.randint(0, 9))]
        for _ in range(rng.randint(0, 5)):
            kind = rng.choice(["image", "video", "audio", "av"] if paired else ["image", "video", "audio"])
            if kind == "image":
                parts.append(("image", 1, 2 * rng.randint(1, 4), 2 * rng.randint(1, 4), 1.0))
            elif kind == "audio":
                parts.append(("audio", rng.randint(1, 30)))
            else:
                kind = "av" if paired else kind
                parts.append((kind, rng.randint(1, 5), 2 * rng.randint(1, 3), 2 * rng.randint(1, 3), rng.choice([0.37, 1.16, 2.0, 3.2])) + ((rng.randint(1, 160),) if kind == "av" else ()))
            parts.append(("text", rng.choice([0, 0, 1, 5])))
        if parts == [("text", 0)]:
            parts = [("text", 3)]
        samples[s] = (rng.randint(0, 3), parts, rng.randint(0, 2))
    assert placed(spark, samples, paired) == expected(samples, paired)


def test_rows_and_grids_that_disagree(spark):
    tokens, grids, audios = tables(spark, {1: (1, [("image", 1, 4, 4, 1.0), ("text", 2)], 0), 2: (0, [("text", 2)], 0), 3: (0, [("image", 1, 4, 4, 1.0)], 0)})
    short = grids.where("sample_id = 1").selectExpr("sample_id", "modality", "k", "grid_t", "grid_h + 2 AS grid_h", "grid_w", "sec")
    got = {(r.sample_id, r.error, r.t) for r in positions_from_ids(tokens, short, audios).collect()}
    assert got == {(1, "grid_len_mismatch", None), (2, None, 0), (2, None, 1), (3, "grid_missing", None)}
    bare = tokens.where(f"token_id <> {VS}")
    assert {r.error for r in positions_from_ids(bare, grids, audios).where("sample_id = 3").collect()} == {"start_missing"}


def test_without_grids_rows_count(spark):
    tokens, _, audios = tables(spark, {1: (2, [("text", 3)], 0)})
    got = [(r.pos, r.t, r.h, r.w, r.delta) for r in positions_from_ids(tokens, None, audios).orderBy("pos").collect()]
    assert got == [(0, 1, 1, 1, 0), (1, 1, 1, 1, 0), (2, 0, 0, 0, 0), (3, 1, 1, 1, 0), (4, 2, 2, 2, 0)]


@pytest.mark.parametrize("paired", [False, True])
def test_tasks_hold_no_more_rows_as_the_input_grows(spark, monkeypatch, paired):
    """Rows are dealt by their number, not by the bytes of a shuffle, of which a few hundred samples would be one task."""
    monkeypatch.setattr(positions, "TASK_ROWS", 100, raising=False)
    samples = {s: (1, [("text", 2), ("image", 1, 4, 4, 1.0), ("text", 5)], 0) for s in range(200)}
    done = positions_from_ids(*tables(spark, samples), audio_in_video=paired)
    rows = done.where("pos > 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 12 and max(r["count"] for r in rows) < 500
    assert {(r.sample_id, r.pos): (r.t, r.h, r.w, r.delta, r.error) for r in done.collect()} == expected(samples, paired)
