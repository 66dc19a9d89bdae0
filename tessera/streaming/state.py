"""Structured Streaming forms: running positions, pending replies, and media planning on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

class Continuation(StatefulProcessor):
    """What a conversation carries from step to step: rows so far, the delta of its first rows, whether its media have
    been shown, and a queue of replies of which each step takes the head and the last one stays (R1, R2).

    Rows are steps (``reply`` null) or replies (``final`` on the last). A step whose reply has not come waits for it;
    once the last is known, steps beyond it take that one. With ``replies`` off, steps never wait. Numbers of a key's
    micro-batch are held while it is worked on, and queued replies and waiting steps in state.
    """

    OUT = "conv long, batch long, step long, start long, len long, media string, reply long"

    def __init__(self, replies: bool) -> None:
        self.replies = replies

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "seen long, delta long, steps long, last long, done boolean")
        self.queue = handle.getListState("queue", "reply long")
        self.waiting = handle.getListState("waiting", "batch long, step long, start long, len long, media string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, delta, steps, last, done = self.marks.get() if self.marks.exists() else (0, None, 0, None, False)
        got = pd.concat(list(rows), ignore_index=True).sort_values("batch", kind="stable")
        new = got[got["reply"].isna()]
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        if len(new):
            delta = int(new["delta"].iloc[0]) if delta is None else delta
            lens = new["len"].to_numpy(np.int64)
            ends = seen + np.cumsum(lens)
            media = [None] * len(new)
            if not steps:  # later rows find them in what the first ones left behind
                media[0] = new["media"].iloc[0]
            waiting += zip(new["batch"].tolist(), range(steps, steps + len(new)), (ends - lens + delta).tolist(), lens.tolist(), media)
            seen, steps = int(ends[-1]), steps + len(new)
        ready: list[tuple] = []
        if self.replies:
            come = got[got["reply"].notna()]
            queue = [r[0] for r in self.queue.get()] if self.queue.exists() else []
            queue += [int(r) for r in come["reply"]]
            done = bool(done or come["final"].any())
            take = min(len(waiting), len(queue))
            ready = [(*w, r) for w, r in zip(waiting[:take], queue)]
            last = queue[take - 1] if take else last
            waiting, queue = waiting[take:], queue[take:]
            if done and not queue and last is not None:
                ready, waiting = ready + [(*w, last) for w in waiting], []
            self._keep(self.queue, [(r,) for r in queue])
        else:
            ready, waiting = [(*w, None) for w in waiting], []
        self._keep(self.waiting, waiting)
        self.marks.update((seen, delta, steps, last, done))
        if ready:
            frame = pd.DataFrame(ready, columns=["batch", "step", "start", "len", "media", "reply"])
            yield frame.assign(conv=key[0], reply=frame["reply"].astype("Int64"))[[c.split()[0] for c in self.OUT.split(", ")]]

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def continuation(rows: DataFrame, replies: bool) -> DataFrame:
    """Steps of a stream of ``conv, batch, len, delta, media, reply, final`` with their start, media and reply."""
    return rows.groupBy("conv").transformWithStateInPandas(Continuation(replies), Continuation.OUT, "Append", "None")


def stream_positions(rows: DataFrame) -> DataFrame:
    """``(conv, batch, i, position, media)``: rows of appended batches count on from the first one's delta (R1), and a
    conversation's media come with its first batch alone. Batches of a conversation come in order."""
    steps = continuation(rows, replies=False).where("len > 0")
    steps = steps.select("conv", "batch", "start", "media", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("i"))
    return steps.select("conv", "batch", "i", (F.col("start") + F.col("i")).alias("position"), "media")


def stream_reply_zip(rows: DataFrame) -> DataFrame:
    """``(conv, batch, step, reply)``: each step takes the next reply of its conversation, the last one for ever (R2)."""
    return continuation(rows, replies=True).select("conv", "batch", "step", "reply")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what a file stream holds into Parquet at ``path``."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def plan_stream(messages: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Run a batch plan on each micro-batch of messages; its result is a folder of that epoch.

    An epoch that runs again, after a failure, replaces its own folder and nothing else. The plan may join static
    tables: it is planned anew for each micro-batch.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
