"""Column expressions of the planning rules. Sizes and frames are longs, rates and budgets doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the planning rules.
FACTOR = 28
IMAGE_PIXELS = (50176, 1254400)
FRAME_PIXELS = (12544, 100352)
MAX_RATIO = 200
FPS = 2.0
MIN_FRAMES, MAX_FRAMES = 2, 768
TOTAL_PIXELS = 90316800
MERGE = 2
PATCH = 14


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def round_by(x: Column, factor: int = FACTOR) -> Column:
    """To the nearest multiple, halves to the even one."""
    return (F.rint(_d(x) / factor) * factor).cast("long")


def ceil_by(x: Column, factor: int = FACTOR) -> Column:
    return (F.ceil(_d(x) / factor) * factor).cast("long")


def floor_by(x: Column, factor: int = FACTOR) -> Column:
    return (F.floor(_d(x) / factor) * factor).cast("long")


def smart_resize(height: Column, width: Column, low: Column | int, high: Column | int, factor: int = FACTOR) -> Column:
    """``struct(h, w, error)``: multiples of ``factor`` with an area in ``[low, high]`` at about the same ratio.

    The lower clamp holds before the area test only, so a thin image can shrink to a zero side (``zero_side``).
    """
    h, w, low, high = _d(height), _d(width), _d(low), _d(high)
    h0, w0 = F.greatest(F.lit(factor).cast("long"), round_by(h, factor)), F.greatest(F.lit(factor).cast("long"), round_by(w, factor))
    shrink, grow = F.sqrt(h * w / high), F.sqrt(low / (h * w))
    big, small = h0 * w0 > high, h0 * w0 < low
    h1 = F.when(big, floor_by(h / shrink, factor)).when(small, ceil_by(h * grow, factor)).otherwise(h0)
    w1 = F.when(big, floor_by(w / shrink, factor)).when(small, ceil_by(w * grow, factor)).otherwise(w0)
    ratio = (F.least(h, w) <= 0) | (F.greatest(h, w) > MAX_RATIO * F.least(h, w))
    error = F.when(ratio, "ratio").when((h1 == 0) | (w1 == 0), "zero_side")
    return F.struct(F.when(~ratio, h1).alias("h"), F.when(~ratio, w1).alias("w"), error.alias("error"))


def frame_count(total: Column, video_fps: Column, fps: Column, nframes: Column, min_frames: Column, max_frames: Column) -> Column:
    """``struct(n, error)``: an even number of frames; the upper bound wins over the lower one."""
    low = ceil_by(F.coalesce(_d(min_frames), F.lit(float(MIN_FRAMES))), 2)
    high = floor_by(F.coalesce(_d(max_frames), F.least(F.lit(float(MAX_FRAMES)), _d(total))), 2)
    rated = _d(total) / _d(video_fps) * F.coalesce(_d(fps), F.lit(FPS))
    bounded = F.least(F.least(F.greatest(rated, _d(low)), _d(high)), _d(total))
    n = F.when(nframes.isNotNull(), round_by(nframes, 2)).otherwise(floor_by(bounded, 2))
    both = fps.isNotNull() & nframes.isNotNull()
    error = F.when(both, "fps_and_nframes").when(~n.between(2, total), "nframes_range")
    return F.struct(F.when(error.isNull(), n).alias("n"), error.alias("error"))


def sampled_fps(n: Column, total: Column, video_fps: Column) -> Column:
    return _d(n) / F.greatest(_d(total), F.lit(1e-6)) * _d(video_fps)


def frame_indices(n: Column, total: Column) -> Column:
    """``n`` (2 or more) evenly spread indices of ``0 .. total - 1``, halves to the even one."""
    step = (_d(total) - 1) / (n - 1)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.rint(i * step).cast("long"))


def frame_budget(n: Column, min_pixels: Column, max_pixels: Column, total_pixels: Column) -> Column:
    """Pixels that a frame may have; a given maximum can only lower it."""
    low = F.coalesce(_d(min_pixels), F.lit(float(FRAME_PIXELS[0])))
    total = F.coalesce(_d(total_pixels), F.lit(float(TOTAL_PIXELS)))
    most = F.greatest(F.least(F.lit(float(FRAME_PIXELS[1])), total / n * 2), F.floor(low * 1.05).cast("double"))
    return F.least(F.coalesce(_d(max_pixels), most), most)


def audio_lengths(mel: Column) -> Column:
    """``struct(frames, tokens)`` after two halvings; divisions round down, also below zero."""
    a = F.floor((_d(mel) - 1) / 2) + 1
    return F.struct(a.cast("long").alias("frames"), (F.floor((a - 2) / F.lit(2.0)) + 1).cast("long").alias("tokens"))


def vision_tokens(t: Column, h: Column, w: Column, merge: int = MERGE) -> Column:
    return F.floor(t * h * w / F.lit(float(merge * merge))).cast("long")


def mel_to_db(values: Column) -> Column:
    """Log-mel values as decibels, scaled to -1 .. 1."""
    floor = 10 ** (-115 / 20)
    db = lambda x: 20 * F.log10(F.greatest(F.lit(floor), F.exp(_d(x)))) - 20
    return F.transform(values, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * ((db(x) + 115) / 115) - 1)))


def clamp_unit(values: Column) -> Column:
    return F.transform(values, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _d(x))))


def sinusoids(position: Column, channels: int, scale: float = 1.0) -> Column:
    """Sines, then cosines, of a position at ``channels / 2`` falling frequencies."""
    if channels % 2:
        raise ValueError("channels must be even")
    half = channels // 2
    angle = lambda i: _d(position) * scale * F.exp(-F.log(F.lit(10000.0)) / (half - 1) * i)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))
