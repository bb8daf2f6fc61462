"""The stateful operators on streams of packets, keyed by stream, with the same step rules as in batch.

Rows that come late within ``delay_ms`` of event time are put in order before the step rules see them; what is
older than that is dropped, as a watermark would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinemill.functions import scoring as S

KEPT = "video_id long, frame_id long, timestamp_ms double, fps double"


def keep_step(last: float | None, t: float, fps: float) -> bool:
    """Whether the scheduler keeps a row at ``t`` after the last kept one."""
    return last is None or (t > last and t - last >= 1000.0 / max(fps, 0.01))


def _scheduled(delay_ms: float, idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest, waiting = state.get if state.exists else (None, None, [])
        waiting = [tuple(x) for x in waiting or []]
        ended = state.hasTimedOut
        rows = [] if ended else [r for b in batches for r in b[["frame_id", "timestamp_ms", "fps"]].itertuples(index=False, name=None)]
        ended = ended or any(r[1] != r[1] or r[1] is None for r in rows)
        done = newest - delay_ms if newest is not None else None
        waiting += [(int(f), float(t), float(r)) for f, t, r in rows if t is not None and t == t and (done is None or t > done)]
        if waiting:
            newest = max([w[1] for w in waiting] + ([newest] if newest is not None else []))
        limit = None if newest is None else newest if ended else newest - delay_ms
        ready = sorted((w for w in waiting if w[1] <= limit), key=lambda w: (w[1], w[0])) if limit is not None else []
        out = []
        for f, t, r in ready:
            if keep_step(last, t, r):
                out.append((key[0], f, t, r))
                last = t
        rest = [list(map(float, w)) for w in waiting if w not in set(ready)]
        if ended and not rest and state.hasTimedOut:
            state.remove()
        else:
            # After an end nothing older than what was given out may come any more.
            state.update((last, newest + delay_ms if ended and newest is not None else newest, rest))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["video_id", "frame_id", "timestamp_ms", "fps"])

    return run


def schedule_stream(packets: DataFrame, *, delay_ms: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """The rows that the adaptive-rate scheduler keeps of a stream of (video_id, frame_id, timestamp_ms, fps).

    With a delay of 0 a row must come after all before it in its batch order of time; with ``delay_ms`` rows up
    to that late are put in order. The last ``delay_ms`` of a stream wait for more, until a row without a
    time says that the stream has ended, or, with ``idle_ms``, none has come for so long: then they are given out. (Spark
    keeps a query with such a time-out running also under the trigger availableNow.)
    """
    return packets.groupBy("video_id").applyInPandasWithState(
        _scheduled(delay_ms, idle_ms), KEPT, "last double, newest double, waiting array<array<double>>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def seconds_stream(packets: DataFrame, *, delay: str = "10 seconds") -> DataFrame:
    """Means per stream and second of a stream with an ``at`` timestamp column, by watermark and tumbling window."""
    grouped = packets.withWatermark("at", delay).groupBy("video_id", F.window("at", "1 second"))
    rows = grouped.agg(
        F.avg("motion_score").alias("motion_score"),
        F.avg("audio_energy").alias("audio_energy"),
        F.avg("novelty_score").alias("novelty_score"),
        F.bool_or(F.col("scene_change")).alias("scene_change"),
        F.count("*").alias("packets"),
    )
    return rows.select("video_id", F.col("window.start").alias("second"), "motion_score", "audio_energy", "novelty_score", "scene_change", "packets").withColumn(
        "action_label", S.action_label("motion_score")
    )
