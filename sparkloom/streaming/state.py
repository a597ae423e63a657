"""Streaming twins of the bounded history and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = "conv_id long, turn long, role string, text string, history array<string>"
STATE = "messages array<string>"


def bounded_history(stream: DataFrame, max_turns: int) -> DataFrame:
    """Each message of a stream with the texts of up to 2 * max_turns before it; a
    conversation's state never holds more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for r in rows.itertuples():
            out.append((r.conv_id, r.turn, r.role, r.text, list(held)))
            held = (held + [r.text])[-2 * max_turns :]
        state.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, HISTORY, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_requests(stream: DataFrame, key: str, ts: str, *, window: str = "60 seconds", slide: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests by key in sliding windows; later rows than the watermark are left out."""
    timed = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", window, slide), key).agg(F.count("*").alias("requests")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests")


def chunks(answers: DataFrame, size: int = 20) -> DataFrame:
    """(id, position, chunk): an answer's text in pieces of size characters, in order."""
    count = F.ceil(F.length("text") / size).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return answers.select("id", F.posexplode(F.transform(places, lambda i: F.substring(F.col("text"), (i - 1) * size + 1, F.lit(size)))).alias("position", "chunk"))
