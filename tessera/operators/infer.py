"""Batch inference with a caller's model, over batches of prompts of like length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import completion, strip_special

#: A model takes (ids, mask), both [batch, width] and padded on the left, and returns [batch, width + new].
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Ids that stand for one token of a medium in a prompt.
PLACEHOLDERS = {"image": 90003, "video": 90004, "audio": 90005}
#: Ids of a batch, its padding counted.
BATCH_TOKENS = 1 << 16
#: Ids of finished batches that go to Spark in one frame: a frame for each batch would cost more than the batch.
FRAME_TOKENS = 1 << 20
VOCABULARY = 50_000
_loaded: dict[Callable[[], Model], Model] = {}


def prompts(planned: DataFrame, text: str = "chars") -> DataFrame:
    """``(sample_id, ids)`` of planned elements (``conv_id, turn, elem_pos, role, modality, tokens``): a medium is as many
    placeholders as its tokens, a text as many ids made from its number in column ``text``.

    Elements stand in document order; a caller with a tokenizer puts its own ids in place of the texts'.
    """
    placeholder = F.lit(None).cast("long")
    for name, token in PLACEHOLDERS.items():
        placeholder = F.when(F.col("modality") == name, token).otherwise(placeholder)
    made = F.transform(F.sequence(F.lit(1).cast("long"), F.col("tokens")), lambda i: (F.col(text) * 31 + i) % VOCABULARY)
    ids = F.when(F.col("role") == "text", made).otherwise(F.array_repeat(placeholder, F.col("tokens").cast("int")))
    rows = planned.where("role <> 'track' AND tokens > 0").select("conv_id", F.struct("turn", "elem_pos", "role", ids.alias("ids")).alias("x"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select(F.col("conv_id").alias("sample_id"), F.flatten("x.ids").alias("ids"))


def batch_inference(prompts: DataFrame, load: Callable[[], Model], batch: int = 16, pad_id: int = 0, special: tuple[int, ...] = (), speech: bool = False, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``(sample_id, completion, n, width)`` for ``prompts`` (``sample_id, ids``); ``width - n`` ids were padding.

    ``load`` gives the model, once in each worker. Prompts are dealt over tasks by ranges of length and sorted there, so
    a batch, which may span Arrow batches, holds prompts of like length over the whole table; it has at most ``batch``
    rows and ``batch_tokens`` ids. Ids named in ``special`` are taken out of completions, no others. Speech needs
    batches of one.
    """
    if speech and batch != 1:
        raise ValueError("batch_audio: speech output needs batches of one")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if load not in _loaded:
            _loaded[load] = load()
        model, held, made = _loaded[load], [], []

        def done() -> None:
            width = max(len(own) for _, own in held)
            ids = np.full((len(held), width), pad_id, dtype=np.int64)
            mask = np.zeros((len(held), width), dtype=np.int64)
            for k, (_, own) in enumerate(held):
                ids[k, width - len(own) :], mask[k, width - len(own) :] = own, 1
            out = np.asarray(model(ids, mask), dtype=np.int64)
            made.extend((sample, row, len(own), width) for (sample, own), row in zip(held, out))
            held.clear()

        def frame() -> pd.DataFrame:
            found = pd.DataFrame(made, columns=["sample_id", "out", "n", "width"])
            made.clear()
            return found

        ids_made = 0
        for part in parts:
            for sample, own in zip(part["sample_id"], part["ids"]):
                widest = max([len(own), *(len(x) for _, x in held[-1:])])
                if held and (len(held) == batch or widest * (len(held) + 1) > batch_tokens):
                    done()
                    if ids_made >= FRAME_TOKENS:
                        yield frame()
                        ids_made = 0
                held.append((sample, own))
                ids_made += len(own)
        if held:
            done()
        if made:
            yield frame()

    width = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prompts.select("sample_id", "ids", F.size("ids").alias("n")).repartitionByRange(width, "n", "sample_id").sortWithinPartitions("n", "sample_id")
    out = dealt.select("sample_id", "ids").mapInPandas(run, "sample_id long, out array<long>, n int, width int")
    return out.select("sample_id", strip_special(completion(F.col("out"), F.col("width")), list(special)).alias("completion"), "n", "width")


def padding_share(done: DataFrame) -> DataFrame:
    """``(share)``: padding among all ids that the model was given."""
    return done.agg((F.sum(F.col("width") - F.col("n")) / F.sum("width")).alias("share"))
