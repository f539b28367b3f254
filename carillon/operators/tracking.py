"""Tracks of spectral peaks over frames, their features and candidate selection.

The frame loop is sequential inside one recording: it is an Arrow kernel by recording.  What
follows from the track points is relational.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import le_tol, ratio
from .kernels import assign

BY = ["recording_id", "track_id"]
_FAR = 1e12


@dataclass(frozen=True)
class Rules:
    """What joins a peak to a track: relative distance, frames that may be missed, least points, weights, and limits of cost."""

    tolerance: float = 0.05
    max_gap: int = 1
    min_length: int = 2
    weights: tuple[float, float] = (1.0, 0.0)
    max_cost: float = 2.0
    ambiguity: float = 0.05
    near: float = 0.9


class Follower:
    """The tracks of one recording, frame after frame.

    Only tracks that may go on are held: the last point of each, where it began, and the points of those that are
    not long enough to count yet.  So what is held does not grow with the recording, and a state can be written down and taken up.
    A track's points are (begin_frame, begin_hz, frame, frequency, amplitude, cost, margin, ambiguous, near).
    """

    def __init__(self, rules: Rules, active: list[dict] | None = None, frame: int | None = None) -> None:
        self.rules, self.active, self.frame = rules, active or [], frame

    def state(self) -> str:
        return json.dumps([self.frame, self.active])

    @classmethod
    def of(cls, rules: Rules, state: str) -> Follower:
        frame, active = json.loads(state)
        return cls(rules, active, frame)

    def step(self, frame: int, peaks: list[tuple[float, float]]) -> list[tuple]:
        """The points that this frame's (frequency, amplitude) peaks settle."""
        r, out = self.rules, []
        self.frame = frame
        self.active = [t for t in self.active if frame - t["last"][0] <= r.max_gap + 1]
        before = len(self.active)
        taken: set[int] = set()

        def add(track: dict, point: tuple) -> None:
            track["last"] = point[:3]
            if track["held"] is None:
                out.append((*track["begin"], *point))
            else:
                track["held"].append(point)
                if len(track["held"]) >= r.min_length:
                    out.extend((*track["begin"], *p) for p in track["held"])
                    track["held"] = None

        if before and peaks:
            f0, a0 = (np.array([t["last"][i] for t in self.active])[:, None] for i in (1, 2))
            f1, a1 = (np.array([p[i] for p in peaks])[None] for i in (0, 1))
            apart = np.abs(f0 - f1) / np.maximum(f0, f1)
            louder = np.maximum(a0, a1)
            costs = r.weights[0] * apart / r.tolerance + r.weights[1] * np.where(louder > 0, np.abs(a0 - a1) / np.where(louder > 0, louder, 1), 0)
            costs = np.where(apart <= r.tolerance, costs, _FAR)
            for row, column in assign(costs):  # assigned first, gated after
                cost = costs[row, column]
                if cost > r.max_cost:
                    continue
                others = np.concatenate([np.delete(costs[row], column), np.delete(costs[:, column], row)])
                others = others[others < _FAR]
                margin = float(others.min() - cost) if len(others) else None
                add(self.active[row], (frame, *peaks[column], float(cost), margin, margin is not None and margin <= r.ambiguity, bool(cost >= r.near * r.max_cost)))
                taken.add(column)
        for i, p in enumerate(peaks):
            if i not in taken:
                track = {"begin": (frame, p[0]), "last": (frame, *p), "held": []}
                self.active.append(track)
                add(track, (frame, *p, None, None, False, False))
        return out


def numbered(points: DataFrame) -> DataFrame:
    """Points by begin of their track, with ``track_id`` in order of begin instead."""
    # a row a track, and not a point, goes through the ordered window
    tracks = points.select("recording_id", "begin_frame", "begin_hz").distinct()
    tracks = tracks.withColumn("track_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("begin_frame", "begin_hz")).cast("long") - 1)
    found = points.join(tracks, ["recording_id", "begin_frame", "begin_hz"])
    return found.select("recording_id", "track_id", "frame", "t_s", "frequency_hz", "amplitude", "cost", "margin", "ambiguous", "near_threshold")


_POINTS = "begin_frame long, begin_hz double, frame long, t_s double, frequency_hz double, amplitude double, cost double, margin double, ambiguous boolean, near_threshold boolean"


def track_long(peaks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``track_peaks`` for recordings of any length: peaks come in order, batch by batch, and only the follower's state is held."""
    rules = rules or Rules()
    kind = dict(peaks.dtypes)["recording_id"]
    names = ["recording_id", *(c.split()[0] for c in _POINTS.split(", "))]
    types = [pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 5, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, follower, frame, peaks_of, times = None, None, None, [], {}

        def settle() -> list[tuple]:
            """Points of the frame that has come whole; times of frames that no held point needs are forgotten."""
            if follower is None:
                return []
            out = [(own, *p[:3], times[p[2]], *p[3:]) for p in follower.step(frame, peaks_of)]
            needed = {p[0] for t in follower.active for p in t["held"] or ()}
            for n in [n for n in times if n not in needed]:
                del times[n]
            return out

        for batch in batches:
            rows: list[tuple] = []
            kinds = batch.schema.field("recording_id").type
            for name, n, t, f, a in zip(*(batch.column(c).to_pylist() for c in ("recording_id", "frame", "t_s", "f_hz", "mag")), strict=True):
                if follower is None or name != own or n != frame:
                    rows += settle()
                    if follower is None or name != own:
                        own, follower, times = name, Follower(rules), {}
                    frame, peaks_of = n, []
                times[n] = t
                peaks_of.append((f, a))
            yield table(rows, kinds)
        if follower is not None:
            yield table(settle(), kinds)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *types], strict=True)], names)

    ordered = peaks.select("recording_id", "frame", "t_s", "f_hz", "mag").repartition("recording_id").sortWithinPartitions("recording_id", "frame", "f_hz")
    return numbered(ordered.mapInArrow(run, f"recording_id {kind}, {_POINTS}"))


def track_peaks(
    peaks: DataFrame,
    tolerance: float = 0.05,
    max_gap: int = 1,
    min_length: int = 2,
    weights: tuple[float, float] = (1.0, 0.0),
    max_cost: float = 2.0,
    ambiguity: float = 0.05,
    near: float = 0.9,
) -> DataFrame:
    """Track points of (recording_id, frame, t_s, f_hz, mag): one-to-one assignment from frame to frame."""
    names = ["recording_id", "track_id", "frame", "t_s", "frequency_hz", "amplitude", "cost", "margin", "ambiguous", "near_threshold"]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("frame", "t_s", "f_hz", "mag")), strict=True), key=lambda r: (r[0], r[2]))
        when = {r[0]: r[1] for r in rows}
        frames: list[tuple[int, list[tuple[float, float]]]] = []
        for frame, _, f, a in rows:
            if not frames or frames[-1][0] != frame:
                frames.append((frame, []))
            frames[-1][1].append((f, a))
        follower = Follower(Rules(tolerance, max_gap, min_length, weights, max_cost, ambiguity, near))
        found = [p for frame, held in frames for p in follower.step(frame, held)]
        number = {b: i for i, b in enumerate(sorted({p[:2] for p in found}))}
        points = sorted((number[p[:2]], *p[2:]) for p in found)
        name = table.column("recording_id")[0].as_py()
        columns = list(zip(*((name, t, f, when[f], *rest) for t, f, *rest in points), strict=True)) or [[]] * len(names)
        kinds = [table.column("recording_id").type, pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.bool_(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = dict(peaks.dtypes)["recording_id"]
    schema = f"recording_id {kind}, track_id long, frame long, t_s double, frequency_hz double, amplitude double, cost double, margin double, ambiguous boolean, near_threshold boolean"
    return peaks.select("recording_id", "frame", "t_s", "f_hz", "mag").groupBy("recording_id").applyInArrow(run, schema)


def assignment_margins(costs: DataFrame, row: str = "row", column: str = "col") -> DataFrame:
    """(row, col, cost): how much dearer the next choice of the row and of the column is; the least of both."""

    def other(by: str) -> Column:
        w = Window.partitionBy("recording_id", by).orderBy("cost")
        two = F.collect_list("cost").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.when(F.size(two) > 1, F.when(F.row_number().over(w) == 1, F.element_at(two, 2)).otherwise(F.element_at(two, 1)) - F.col("cost"))

    m = costs.select("*", other(row).alias("row_margin"), other(column).alias("column_margin"))
    return m.withColumn("margin", F.least("row_margin", "column_margin"))


def track_features(points: DataFrame, last_frame: int | None = None) -> DataFrame:
    """One row a track: counts, gaps, coverage, statistics of frequency and amplitude, direction of steps."""
    w = Window.partitionBy(*BY).orderBy("frame")
    p = points.select("*", (F.col("frame") - F.lag("frame").over(w) - 1).alias("gap"), (F.col("frequency_hz") - F.lag("frequency_hz").over(w)).alias("step"))
    steps = F.count("step")
    m = p.groupBy(*BY).agg(
        F.count("*").alias("observation_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_if(F.col("gap") > 0).alias("gap_count"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"),
        (F.max("t_s") - F.min("t_s")).alias("duration_s"), F.avg("frequency_hz").alias("frequency_mean"), F.median("frequency_hz").alias("frequency_median"), F.stddev_pop("frequency_hz").alias("frequency_std"),
        F.min("frequency_hz").alias("frequency_min"), F.max("frequency_hz").alias("frequency_max"), (F.max_by("frequency_hz", "frame") - F.min_by("frequency_hz", "frame")).alias("drift_hz"),
        F.max("amplitude").alias("amplitude_max"), F.min_by("amplitude", "frame").alias("amplitude_first"), F.max_by("amplitude", "frame").alias("amplitude_last"), F.median("amplitude").alias("amplitude_median"),
        ratio(F.count_if(F.col("step") > 1e-12).cast("double"), steps.cast("double")).alias("up_fraction"), ratio(F.count_if(F.col("step") < -1e-12).cast("double"), steps.cast("double")).alias("down_fraction"),
    )
    m = m.select("*", (F.col("observation_count") / (F.col("last_frame") - F.col("first_frame") + 1)).alias("coverage"), ratio(F.col("frequency_std"), F.col("frequency_mean")).alias("relative_stability"))
    return m if last_frame is None else m.withColumn("reaches_end", F.col("last_frame") == last_frame)


def frequency_fit(points: DataFrame, minimum: int = 2) -> DataFrame:
    """Line through frequency over time; r² is missing for a constant."""
    m = points.groupBy(*BY).agg(F.count("*").alias("n"), F.regr_sxx("frequency_hz", "t_s").alias("xx"), F.regr_syy("frequency_hz", "t_s").alias("yy"), F.regr_sxy("frequency_hz", "t_s").alias("xy"), F.avg("t_s").alias("mt"), F.avg("frequency_hz").alias("mf"))
    fine = (F.col("n") >= minimum) & (F.col("xx") > 0)
    slope = F.col("xy") / F.col("xx")
    sse = F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * slope)
    return m.select(
        *BY, "n", fine.alias("success"), F.when(fine, slope).alias("slope_hz_per_s"), F.when(fine, F.col("mf") - slope * F.col("mt")).alias("intercept_hz"),
        F.when(fine & (F.col("yy") > 1e-18), 1 - sse / F.col("yy")).alias("r_squared"), F.when(fine, F.sqrt(sse / F.col("n"))).alias("rmse_hz"),
    )


def amplitude_fit(points: DataFrame, unit: str = "amplitude") -> DataFrame:
    """Line through the log amplitude over time, and the decay time that its slope means."""
    level = F.when(F.col("amplitude") > 0, F.ln("amplitude")) if unit == "amplitude" else F.col("amplitude")
    p = points.select(*BY, "t_s", level.alias("level")).filter("level IS NOT NULL")
    m = p.groupBy(*BY).agg(F.count("*").alias("n"), F.regr_sxx("level", "t_s").alias("xx"), F.regr_syy("level", "t_s").alias("yy"), F.regr_sxy("level", "t_s").alias("xy"))
    fine = (F.col("n") >= 2) & (F.col("xx") > 0)
    slope = F.col("xy") / F.col("xx")
    factor = 1.0 if unit == "amplitude" else 20 / float(np.log(10))
    return m.select(
        *BY, "n", F.when(fine, slope).alias("slope_per_s"), F.when(fine & (slope < -1e-12), -factor / slope).alias("tau_s"), F.when(fine, slope > 1e-12).alias("increasing"),
        F.when(fine & (F.col("yy") > 1e-18), F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).alias("r_squared"),
    )


def preimpact(points: DataFrame, hits: DataFrame, pre: tuple[float, float] = (-1.0, -0.1), post: tuple[float, float] = (0.02, 0.30), rise_db: float = 6.0, minimum: int = 2, slope_tolerance: float = 1e-12, unchanged_db: float = 1.0) -> DataFrame:
    """Level before and after the impact (closed windows), and the class that follows from it."""
    p = points.join(hits.select("recording_id", "hit_s"), "recording_id").withColumn("rel", F.col("t_s") - F.col("hit_s")).filter("amplitude > 0")
    inside = lambda w: (F.col("rel") >= w[0]) & (F.col("rel") <= w[1])
    p = p.select(*BY, "rel", "amplitude", inside(pre).alias("in_pre"), inside(post).alias("in_post"))
    m = p.groupBy(*BY).agg(
        F.count_if("in_pre").alias("pre_points"), F.count_if("in_post").alias("post_points"), F.median(F.when(F.col("in_pre"), F.col("amplitude"))).alias("pre_level"), F.median(F.when(F.col("in_post"), F.col("amplitude"))).alias("post_level"),
        F.regr_sxx(F.when(F.col("in_pre"), F.col("amplitude")), F.col("rel")).alias("xx"), F.regr_sxy(F.when(F.col("in_pre"), F.col("amplitude")), F.col("rel")).alias("xy"),
    )
    change = 20 * F.log10(F.col("post_level") / F.col("pre_level"))
    m = m.select(*BY, "pre_points", "post_points", "pre_level", "post_level", F.when(F.col("xx") > 0, F.col("xy") / F.col("xx")).alias("pre_slope"), change.alias("change_db"))
    absent = F.col("pre_points") == 0
    excited = F.coalesce(absent | le_tol(F.lit(rise_db), F.col("change_db")), F.lit(False))
    falling = F.coalesce(F.col("pre_slope") < -slope_tolerance, F.lit(False))
    kind = (
        F.when(F.col("post_points") < minimum, "insufficient_postimpact_data")
        .when(~absent & (F.col("pre_points") < minimum), "insufficient_preimpact_data")
        .when(absent & excited, "impact_emergent")
        .when(absent, "not_detected_preimpact")
        .when(excited & falling, "reexcited_preexisting_component")
        .when(excited, "impact_amplified")
        .when(falling, "preexisting_decay")
        .when(F.abs("change_db") <= unchanged_db, "persistent_background_tone")
        .otherwise("indeterminate")
    )
    return m.select("*", kind.alias("classification")).withColumn("impact_excited", F.col("classification").isin("impact_emergent", "reexcited_preexisting_component", "impact_amplified"))


def candidate_criteria(features: DataFrame, limits: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Long criteria (recording_id, track_id, criterion, observed, passed); a missing observation fails.

    limits: criterion → (column, ">=" or "<=", threshold).
    """
    rows = []
    for name, (column, op, threshold) in limits.items():
        value = F.col(column).cast("double")
        passed = F.coalesce((value >= threshold) if op == ">=" else (value <= threshold), F.lit(False))
        rows.append(F.struct(F.lit(name).alias("criterion"), value.alias("observed"), F.lit(float(threshold)).alias("threshold"), passed.alias("passed")))
    return features.select(*BY, F.explode(F.array(*rows)).alias("c")).select(*BY, "c.*")


def select_candidates(criteria: DataFrame) -> DataFrame:
    """Every track as a candidate in track order: accepted if all criteria passed, else with its reasons."""
    m = criteria.groupBy(*BY).agg(F.bool_and("passed").alias("accepted"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("criterion")))).alias("reasons"))
    place = Window.partitionBy("recording_id").orderBy("track_id")
    return m.select("recording_id", (F.row_number().over(place) - 1).alias("candidate_id"), "track_id", "accepted", F.concat_ws(",", "reasons").alias("rejection_reasons"))
