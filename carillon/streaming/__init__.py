"""Framing of event streams with watermarks; the same frames as the batch form when nothing is late."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import Follower, Rules


def framed_levels(events: DataFrame, length: str = "10 minutes", hop: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Count, mean and peak of ``value`` by event type in sliding windows of ``ts``; works on streams and tables."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = F.window("ts", length, hop).alias("w")
    m = e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return m.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "peak")


def sessions(events: DataFrame, gap: str = "1 day", late: str | None = "10 minutes") -> DataFrame:
    """Runs of a user's events without a longer pause than ``gap``."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    s = F.session_window("ts", gap).alias("s")
    m = e.groupBy(s, "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return m.select("user_id", F.col("s.start").alias("start"), "n", "total")


_POINTS = "recording_id string, begin_frame long, begin_hz double, frame long, frequency_hz double, amplitude double, cost double, margin double, ambiguous boolean, near_threshold boolean, late boolean"


def track_stream(peaks: DataFrame, rules: Rules | None = None, hold: int = 0) -> DataFrame:
    """Track points of a stream of (recording_id, frame, f_hz, mag), each by where its track began, as soon as they are settled.

    A recording's state is its follower and the peaks of its last ``hold`` frames, which wait for what
    comes late; nothing else is kept.  Peaks of a frame that has been settled already are not dropped but come out as
    ``late``, without a track.  ``tracking.numbered`` gives a finished recording the ids of ``track_peaks``.
    """
    rules = rules or Rules()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting = state.get if state.exists else (None, "[]")
        follower = Follower.of(rules, own) if own else Follower(rules)
        held = [tuple(p) for p in json.loads(waiting)]
        for pdf in batches:
            held += list(zip(pdf.frame.astype(int).tolist(), pdf.f_hz.tolist(), pdf.mag.tolist(), strict=True))
        done = follower.frame if follower.frame is not None else -1
        rows = [(key[0], None, None, n, f, a, None, None, None, None, True) for n, f, a in held if n <= done]
        held = sorted(p for p in held if p[0] > done)
        newest = held[-1][0] if held else done
        ready = [p for p in held if p[0] <= newest - hold]
        for n in sorted({p[0] for p in ready}):
            rows += [(key[0], *p, False) for p in follower.step(n, [(f, a) for m, f, a in ready if m == n])]
        state.update((follower.state(), json.dumps([p for p in held if p[0] > newest - hold])))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _POINTS.split(", ")])
        yield out.astype({"begin_frame": "Int64", "frame": "int64", "ambiguous": "boolean", "near_threshold": "boolean", "late": "bool", **{c: "float64" for c in ("begin_hz", "frequency_hz", "amplitude", "cost", "margin")}})

    named = peaks.select(F.col("recording_id").cast("string").alias("recording_id"), "frame", "f_hz", "mag")
    return named.groupBy("recording_id").applyInPandasWithState(run, _POINTS, "follower string, waiting string", "append", GroupStateTimeout.NoTimeout)
