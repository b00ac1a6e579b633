"""Cycles of live samples by Structured Streaming.

`live_cycles` keeps one open cycle per recording as state and emits measures of each cycle when its end marker arrives; it expects samples of a recording in order of
idx within a micro-batch and across them. `tumbling` is a watermarked window aggregate of a channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rec long, wave_no int, n long, mean double, low double, high double"
STATE = "wave_no int, n long, total double, low double, high double"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    wave, n, total, low, high = state.get if state.exists else (0, 0, 0.0, float("inf"), float("-inf"))
    out = []
    for frame in frames:
        frame = frame.sort_values("idx")
        for starts, x in zip(frame["starts"].tolist(), frame["x"].tolist(), strict=True):
            if starts:
                out.append((key[0], wave, n, total / n if n else 0.0, low if n else 0.0, high if n else 0.0))
                wave, n, total, low, high = wave + 1, 0, 0.0, float("inf"), float("-inf")
            n, total, low, high = n + 1, total + x, min(low, x), max(high, x)
    state.update((wave, n, total, low, high))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def live_cycles(samples: DataFrame, channel: str, index: str) -> DataFrame:
    """rec, wave_no, n, mean, low, high of every closed cycle; samples: rec, idx, markers and the channel."""
    slim = samples.select("rec", "idx", F.array_contains("markers", index).alias("starts"), F.col(f"`{channel}`").alias("x"))
    return slim.groupBy("rec").applyInPandasWithState(_follow, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(samples: DataFrame, time: str, channel: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """rec, window, mean, n of a channel over tumbling windows of event time."""
    return samples.withWatermark(time, late).groupBy("rec", F.window(time, width)).agg(F.avg(f"`{channel}`").alias("mean"), F.count(F.lit(1)).alias("n"))
