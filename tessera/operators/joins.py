"""Joins after key derivation: placeholders, lookups, intervals, neighbour blocks, permutations and clamped zips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a dimension is broadcast; larger ones are joined as Spark sees fit.
SMALL_DIMENSION, SMALL_BYTES = 100_000, 16 << 20


def small(dimension: DataFrame, rows: int = SMALL_DIMENSION, size: int = SMALL_BYTES) -> DataFrame:
    """``dimension`` marked for broadcast if its rows and bytes are counted and small; nested columns never are."""
    kinds = [f.dataType.typeName() for f in dimension.schema]
    if any(k in ("array", "map", "struct", "variant") for k in kinds):
        return dimension
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if k in ("string", "binary", "varchar", "char") else F.lit(16) for c, k in zip(dimension.columns, kinds)), F.lit(0).cast("long"))
    seen = dimension.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return F.broadcast(dimension) if seen.n <= rows and (seen.bytes or 0) <= size else dimension


#: Rows of a sample that one task numbers.
NUMBERED_ROWS = 65_536


def numbered(rows: DataFrame, keys: list[str], order: str = "pos", chunk_rows: int = NUMBERED_ROWS) -> DataFrame:
    """``rows`` with ``k``, their number from 0 among those of equal ``keys``, in order of ``order``, a count from 0.

    In two levels: chunks of ``order`` are counted, a window adds up the counts of earlier chunks, and rows are numbered
    inside their chunk; so a key that holds most rows is many tasks.
    """
    own = [*keys, "__chunk"]
    rows = rows.withColumn("__chunk", F.floor(F.col(order) / F.lit(float(chunk_rows))).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(*own, before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(order)) - 1
    return rows.withColumn("__place", place).join(counts, own).withColumn("k", (F.col("__before") + F.col("__place")).cast("long")).drop("__chunk", "__before", "__place")


def placeholder_join(tokens: DataFrame, features: DataFrame, placeholders: dict[int, str], chunk_rows: int = NUMBERED_ROWS) -> DataFrame:
    """The k-th placeholder of a modality takes the k-th feature.

    ``tokens``: ``sample_id, pos, token_id``; ``features``: ``sample_id, modality, k, vec_id``. Surplus features drop.
    Where tokens have a value ``x`` of their own and features one too, the result's ``x`` is the feature's, or the
    token's where no feature comes, and ``x_text`` is the token's with 0 at placeholders that take a feature. Only
    placeholders are numbered and joined, by sample, modality and number, so a long sample is spread over tasks.
    """
    modality = F.lit(None).cast("string")
    for token, name in placeholders.items():
        modality = F.when(F.col("token_id") == token, name).otherwise(modality)
    rows = tokens.withColumn("modality", modality)
    keys = ["sample_id", "modality", "k"]
    extra = [c for c in features.columns if c not in keys]
    own = [F.lit(None).cast(features.schema[c].dataType).alias(c) if c not in tokens.columns else F.col(c) for c in extra]
    plain = rows.where("modality IS NULL").withColumn("k", F.lit(None).cast("long"))
    held = numbered(rows.where("modality IS NOT NULL"), keys[:2], chunk_rows=chunk_rows)
    if "x" in tokens.columns:
        held, features = held.withColumnRenamed("x", "__own"), features.withColumn("__taken", F.lit(1))
        taken = [F.coalesce("x", "__own").alias("x") if c == "x" else F.col(c) for c in extra]
        taken.append(F.when(F.col("__taken") == 1, 0.0).otherwise(F.col("__own")).alias("x_text"))
        own.append(F.col("x").alias("x_text"))
    else:
        taken = [F.col(c) for c in extra]
    head = ["sample_id", "pos", "token_id", "modality", "k"]
    return held.join(features, keys, "left").select(*head, *taken).unionByName(plain.select(*head, *own))


def length_mismatch(tokens: DataFrame, features: DataFrame, token: int, modality: str) -> DataFrame:
    """Samples whose placeholders and features of a modality differ in number (``audio_len_mismatch``)."""
    want = tokens.where(F.col("token_id") == token).groupBy("sample_id").agg(F.count(F.lit(1)).alias("placeholders"))
    have = features.where(F.col("modality") == modality).groupBy("sample_id").agg(F.count(F.lit(1)).alias("features"))
    rows = want.join(have, "sample_id", "full").select("sample_id", F.coalesce("placeholders", F.lit(0)).alias("placeholders"), F.coalesce("features", F.lit(0)).alias("features"))
    return rows.where("placeholders <> features")


def speaker_lookup(requests: DataFrame, speakers: DataFrame) -> DataFrame:
    return requests.join(small(speakers.withColumnRenamed("name", "speaker")), "speaker").select("req_id", "speaker", "bos_token")


def unknown_speakers(requests: DataFrame, speakers: DataFrame) -> DataFrame:
    return requests.join(small(speakers.select(F.col("name").alias("speaker"))), "speaker", "left_anti").select("req_id", "speaker")


def interval_lookup(points: DataFrame, intervals: DataFrame, key: str = "sample_id", width: int = 64) -> DataFrame:
    """Each point with the intervals ``[start, stop)`` that hold it (J3); null columns where none does.

    ``points``: ``key, pos``; ``intervals``: ``key, start, stop`` and more; gaps and overlaps are fine, an interval that
    is empty holds nothing. Intervals list the bins of ``width`` that they touch, points have one: an equi-join on key
    and bin with an exact test, so neither a range join nor a sort of a key's rows is needed.
    """
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    dealt = intervals.where("start < stop").select("*", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop") - 1))).alias("__bin")).withColumnRenamed(key, "__key")
    rows = points.withColumn("__cell", cell(F.col("pos")))
    inside = (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    return rows.join(dealt, inside, "left").drop("__cell", "__bin", "__key")


def segment_lookup(points: DataFrame, segments: DataFrame, key: str = "sample_id") -> DataFrame:
    """Each point's segment where segments have no ends: the last that starts at or before it. One union, one window.

    ``points``: ``key, pos``; ``segments``: ``key, start, seg_no``, with starts that differ. :func:`interval_lookup` is
    for segments with ends.
    """
    both = points.select(key, "pos", F.lit(1).alias("o"), F.lit(None).cast("long").alias("seg")).unionByName(segments.select(key, F.col("start").alias("pos"), F.lit(0).alias("o"), F.col("seg_no").cast("long").alias("seg")))
    w = Window.partitionBy(key).orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("seg_no", F.last("seg", ignorenulls=True).over(w)).where("o = 1").select(key, "pos", "seg_no")


def block_band_join(left: DataFrame, right: DataFrame, key: str, block: int, back: int = 1, ahead: int = 1) -> DataFrame:
    """Pairs whose blocks differ by ``-back .. ahead`` (J4): the left side lists its neighbour blocks, then an equi-join."""
    own = F.floor(F.col("pos") / float(block)).cast("long")
    a = left.select(key, F.col("pos").alias("pos_a"), F.explode(F.sequence(own - back, own + ahead)).alias("block"))
    b = right.select(key, F.col("pos").alias("pos_b"), own.alias("block"))
    return a.join(b, [key, "block"]).select(key, "pos_a", "pos_b")


def undo_permutation(rows: DataFrame, permutation: DataFrame, key: str) -> DataFrame:
    """Rows in permuted places (``idx``) back at their own (``cell``)."""
    return rows.join(permutation.select(key, "idx", "cell"), [key, "idx"])


def clamped_zip(steps: DataFrame, replies: DataFrame, key: str = "conv") -> DataFrame:
    """Step i takes reply min(i, n - 1) (J6). ``steps``: ``key, step``; ``replies``: ``key, idx, reply``."""
    sizes = replies.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = steps.join(sizes, key).withColumn("idx", F.least(F.col("step"), F.col("n") - 1).cast("long"))
    return rows.join(replies, [key, "idx"]).select(key, "step", "idx", "reply")


def linear_resample(series: DataFrame, every: float, key: str = "item") -> DataFrame:
    """``(key, grid_ts, value)`` on the multiples of ``every`` seconds inside each series, exact at its points.

    Each interval lists the grid points in it, so there is no range join. Of rows at one time, the last counts.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = series.withColumn("t1", F.lead("ts").over(w)).withColumn("v1", F.lead("value").over(w))
    first, last = F.ceil(F.col("ts") / every).cast("long"), F.col("t1") / every
    stop = F.ceil(last).cast("long") - 1  # the right end belongs to the next interval
    rows = rows.where(F.col("t1") > F.col("ts")).withColumn("first", first).withColumn("stop", stop).where("first <= stop")
    rows = rows.select("*", F.explode(F.sequence("first", "stop")).alias("k"))
    at = F.col("k") * F.lit(float(every))
    value = F.col("value") + (F.col("v1") - F.col("value")) * (at - F.col("ts")) / (F.col("t1") - F.col("ts"))
    return rows.select(key, F.col("k").alias("grid"), value.alias("value"))
