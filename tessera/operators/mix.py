"""Training mix, length limits, rewards and group-relative advantages; parameter routing of requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of prompts and completions, and reward weights by component.
PROMPT_TOKENS, COMPLETION_TOKENS = 32768, 2048
WEIGHTS = {"k": 1.0, "k_ratio": 1.0, "a": 1.0, "g_score": 0.0}
_FIRST_ONLY = ("feature_attention_mask", "input_features", "attention_mask")


def training_mix(rows: DataFrame, caps: Mapping[str, int], dataset: str = "dataset", key: str = "doc_id", multi: Column | None = None, use_multi: bool = False) -> DataFrame:
    """All rows of datasets without a cap, and of each other ``caps[name]`` rows, those of the smallest hash of ``key``
    (ties by the key) (D1).

    Rows where ``multi`` holds are a dataset of their own, ``<name>_multi``, which is taken with ``use_multi`` alone. All
    caps are one pass: each task keeps its smallest rows of a dataset before any are shuffled.
    """
    if multi is not None:
        several = F.coalesce(multi, F.lit(False))
        rows = (rows if use_multi else rows.where(~several)).withColumn(dataset, F.when(several, F.concat(dataset, F.lit("_multi"))).otherwise(F.col(dataset)))
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col(dataset) == name, n).otherwise(cap)
    rows = rows.withColumn("__cap", cap)
    order = Window.partitionBy(dataset).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    capped = rows.where("__cap IS NOT NULL").withColumn("__rank", F.row_number().over(order))
    capped = capped.where(F.col("__rank") <= max(caps.values(), default=0)).where("__rank <= __cap").drop("__rank")
    return rows.where("__cap IS NULL").unionByName(capped).drop("__cap")


def request_errors(requests: DataFrame) -> DataFrame:
    """Requests for speech in batches of more than one, as ``error`` ``batch_audio``; needs ``req_id, speech, batch``."""
    return requests.where("speech AND batch > 1").select("req_id", F.lit("batch_audio").alias("error"))


def length_limits(rows: DataFrame, prompt: int = PROMPT_TOKENS, completion: int = COMPLETION_TOKENS) -> DataFrame:
    """Rows whose prompt fits, their completions cut to the limit (D2). ``rows``: ``prompt_tokens, completion_tokens``."""
    return rows.where(F.col("prompt_tokens") <= prompt).withColumn("completion_tokens", F.least("completion_tokens", F.lit(completion)))


def reward(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The weighted sum of reward components (D3)."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    return total


def group_advantage(rows: DataFrame, *group: str, eps: float = 1e-4) -> DataFrame:
    """``advantage``: a reward less its group's mean, over the deviation plus ``eps``; 0 in a group of one."""
    w = Window.partitionBy(*group)
    std = F.coalesce(F.stddev_samp("reward").over(w), F.lit(0.0))
    return rows.withColumn("advantage", (F.col("reward") - F.avg("reward").over(w)) / (std + eps))


def route_params(params: Column, prefix: str, defaults: Mapping[str, str] | None = None, first: bool = False) -> Column:
    """One target's parameters (F4): defaults, prefixed keys without their prefix over them, shared keys where absent.

    Keys in ``_FIRST_ONLY`` go to the first target alone. ``params`` is a map of strings.
    """
    prefixes = ("thinker_", "talker_", "token2wav_")
    own = F.transform_keys(F.map_filter(params, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 2**31 - 1))
    base = F.create_map(*[F.lit(x) for kv in (defaults or {}).items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    fixed = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    shared = F.map_filter(params, lambda k, v: ~(k.startswith(prefixes[0]) | k.startswith(prefixes[1]) | k.startswith(prefixes[2])))
    if not first:
        shared = F.map_filter(shared, lambda k, v: ~k.isin(list(_FIRST_ONLY)))
    return F.map_concat(F.map_filter(shared, lambda k, v: ~F.array_contains(F.map_keys(fixed), k)), fixed)
