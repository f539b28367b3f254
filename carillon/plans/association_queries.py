"""Queries over tracks, candidate references, matches and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment, association, diagnosis, near_assignment, spectrum, tracking, within
from ..operators.stft import frame_peaks
from ..sources.adapters import REF_SQL, SER_SQL, candidate_refs, series
from .registry import query
from .signal_queries import FRAMES_SQL, PEAKS_SQL, bins, frames, r

# ---- tracks -------------------------------------------------------------------------


def tracks(s, d):
    return tracking.track_peaks(frame_peaks(frames(s, d), 0.01), tolerance=0.3, max_gap=1)


query("track_points", tracks)
# the same points, with no more held than the tracks that may go on
query("track_points_long", lambda s, d: tracking.track_long(frame_peaks(frames(s, d), 0.01), tracking.Rules(tolerance=0.3, max_gap=1)))
query("track_features_kernel", lambda s, d: tracking.track_features(tracks(s, d)))


def points(s, d):
    """Track points out of irregular series: four tracks each, with gaps."""
    return series(s, d).select(
        "recording_id", (F.col("n") % 4).alias("track_id"), F.col("n").alias("frame"), "t_s", (100 * (F.col("n") % 4 + 1) + F.col("x") / 100).alias("frequency_hz"), (F.col("x") / 500).alias("amplitude")
    )


POINTS_SQL = f"{SER_SQL}, pt AS (SELECT recording_id, n % 4 AS track_id, n AS frame, t_s, 100 * (n % 4 + 1) + x / 100 AS f, x / 500 AS a FROM ser)"
query(
    "track_features",
    lambda s, d: tracking.track_features(points(s, d)),
    f"""WITH {POINTS_SQL}, g AS (SELECT *, frame - lag(frame) OVER w - 1 AS gap, f - lag(f) OVER w AS step FROM pt WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame))
    SELECT recording_id, track_id, count(*) AS observation_count, min(frame) AS first_frame, max(frame) AS last_frame, count(*) FILTER (WHERE gap > 0) AS gap_count, coalesce(max(gap), 0) AS longest_gap,
      {r('max(t_s)-min(t_s)', 'duration_s')}, {r('avg(f)', 'frequency_mean')}, {r('median(f)', 'frequency_median')}, {r('stddev_pop(f)', 'frequency_std')}, {r('min(f)', 'frequency_min')}, {r('max(f)', 'frequency_max')},
      {r('arg_max(f, frame)-arg_min(f, frame)', 'drift_hz')}, {r('max(a)', 'amplitude_max')}, {r('arg_min(a, frame)', 'amplitude_first')}, {r('arg_max(a, frame)', 'amplitude_last')}, {r('median(a)', 'amplitude_median')},
      {r('count(*) FILTER (WHERE step > 1e-12)/nullif(count(step), 0)', 'up_fraction')}, {r('count(*) FILTER (WHERE step < -1e-12)/nullif(count(step), 0)', 'down_fraction')},
      {r('count(*)/(max(frame)-min(frame)+1)', 'coverage')}, {r('stddev_pop(f)/avg(f)', 'relative_stability')} FROM g GROUP BY 1, 2""",
)
query(
    "track_frequency_fit",
    lambda s, d: tracking.frequency_fit(points(s, d).withColumn("t_s", F.col("t_s") / 86400)),
    f"""WITH {POINTS_SQL}, m AS (SELECT recording_id, track_id, count(*) n, regr_sxx(f, t_s/86400) xx, regr_syy(f, t_s/86400) yy, regr_sxy(f, t_s/86400) xy, avg(t_s/86400) mt, avg(f) mf FROM pt GROUP BY 1, 2)
    SELECT recording_id, track_id, n, n >= 2 AND xx > 0 AS success, {r('xy/nullif(xx, 0)', 'slope_hz_per_s', 4)}, {r('mf-xy/nullif(xx, 0)*mt', 'intercept_hz', 4)}, {r('1-(yy-xy*xy/nullif(xx, 0))/nullif(yy, 0)', 'r_squared', 4)}, {r('sqrt(greatest(0, yy-xy*xy/nullif(xx, 0))/n)', 'rmse_hz', 4)} FROM m""",
    digits=4,
)
query(
    "track_amplitude_fit",
    lambda s, d: tracking.amplitude_fit(points(s, d).withColumn("t_s", F.col("t_s") / 86400)),
    f"""WITH {POINTS_SQL}, m AS (SELECT recording_id, track_id, count(*) n, regr_sxx(ln(a), t_s/86400) xx, regr_syy(ln(a), t_s/86400) yy, regr_sxy(ln(a), t_s/86400) xy FROM pt WHERE a > 0 GROUP BY 1, 2)
    SELECT recording_id, track_id, n, {r('xy/xx', 'slope_per_s', 4)}, {r('CASE WHEN xy/xx < -1e-12 THEN -xx/xy END', 'tau_s', 4)}, xy/xx > 1e-12 AS increasing, {r('xy*xy/(xx*nullif(yy, 0))', 'r_squared', 4)} FROM m""",
    digits=4,
)


def hits(s, d):
    return series(s, d).groupBy("recording_id").agg((F.max("t_s") / 2).alias("hit_s"))


query(
    "preimpact_class",
    lambda s, d: tracking.preimpact(points(s, d), hits(s, d), pre=(-400000.0, 0.0), post=(1.0, 400000.0), rise_db=3.0),
    f"""WITH {POINTS_SQL}, h AS (SELECT recording_id, max(t_s)/2 AS hit FROM ser GROUP BY 1), w AS (SELECT pt.*, t_s - hit AS rel, t_s - hit BETWEEN -400000 AND 0 AS ip, t_s - hit BETWEEN 1 AND 400000 AS io FROM pt JOIN h USING (recording_id) WHERE a > 0),
    m AS (SELECT recording_id, track_id, count(*) FILTER (WHERE ip) np, count(*) FILTER (WHERE io) no, median(a) FILTER (WHERE ip) lp, median(a) FILTER (WHERE io) lo, regr_sxy(a, rel) FILTER (WHERE ip) xy, regr_sxx(a, rel) FILTER (WHERE ip) xx FROM w GROUP BY 1, 2),
    c AS (SELECT *, 20*log10(lo/lp) AS ch, CASE WHEN xx > 0 THEN xy/xx END AS sl FROM m),
    k AS (SELECT *, CASE WHEN no < 2 THEN 'insufficient_postimpact_data' WHEN np > 0 AND np < 2 THEN 'insufficient_preimpact_data' WHEN np = 0 THEN 'impact_emergent' WHEN ch >= 3 AND sl < -1e-12 THEN 'reexcited_preexisting_component'
      WHEN ch >= 3 THEN 'impact_amplified' WHEN sl < -1e-12 THEN 'preexisting_decay' WHEN abs(ch) <= 1 THEN 'persistent_background_tone' ELSE 'indeterminate' END AS cl FROM c)
    SELECT recording_id, track_id, np AS pre_points, no AS post_points, {r('lp', 'pre_level')}, {r('lo', 'post_level')}, {r('sl', 'pre_slope')}, {r('ch', 'change_db')}, cl AS classification, cl IN ('impact_emergent', 'reexcited_preexisting_component', 'impact_amplified') AS impact_excited FROM k""",
)
LIMITS = {
    "minimum_observation_count": ("observation_count", ">=", 2.0),
    "minimum_coverage_fraction": ("coverage", ">=", 0.25),
    "maximum_relative_frequency_stability": ("relative_stability", "<=", 0.008),
    "maximum_absolute_frequency_drift_hz": ("drift_hz", "<=", 3.0),
}


def criteria(s, d):
    return tracking.candidate_criteria(tracking.track_features(points(s, d)), LIMITS)


CRITERIA_SQL = f"""{POINTS_SQL}, ft AS (SELECT recording_id, track_id, count(*)::DOUBLE a, count(*)/(max(frame)-min(frame)+1) b, stddev_pop(f)/avg(f) c, arg_max(f, frame)-arg_min(f, frame) e FROM pt GROUP BY 1, 2),
cr AS (SELECT recording_id, track_id, unnest(['minimum_observation_count', 'minimum_coverage_fraction', 'maximum_relative_frequency_stability', 'maximum_absolute_frequency_drift_hz']) AS criterion, unnest([a, b, c, e]) AS observed,
  unnest([2.0, 0.25, 0.008, 3.0])::DOUBLE AS threshold, unnest([a >= 2, b >= 0.25, c <= 0.008, e <= 3]) AS passed FROM ft)"""
query("candidate_criteria", criteria, f"WITH {CRITERIA_SQL} SELECT recording_id, track_id, criterion, {r('observed', 'observed')}, threshold, passed FROM cr")
query(
    "candidate_select",
    lambda s, d: tracking.select_candidates(criteria(s, d)),
    f"""WITH {CRITERIA_SQL}, m AS (SELECT recording_id, track_id, bool_and(passed) AS accepted, coalesce(string_agg(criterion, ',' ORDER BY criterion) FILTER (WHERE NOT passed), '') AS rejection_reasons FROM cr GROUP BY 1, 2)
    SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY track_id) - 1 AS candidate_id, track_id, accepted, rejection_reasons FROM m""",
)


def peak_costs(s, d):
    """Costs between all of each recording's peaks, counted from below (row) and from above (col)."""
    from pyspark.sql import Window

    up = Window.partitionBy("recording_id").orderBy("k")
    down = Window.partitionBy("recording_id").orderBy(F.desc("k"))
    p = spectrum.peaks(bins(s, d)).select("recording_id", "f_hz", "mag", F.row_number().over(up).alias("u"), F.row_number().over(down).alias("v"))
    left = p.select("recording_id", F.col("u").alias("row"), F.col("f_hz").alias("f"))
    right = p.select("recording_id", F.col("v").alias("col"), F.col("f_hz").alias("g"))
    return left.join(right, "recording_id").select("recording_id", "row", "col", (F.abs(F.col("f") - F.col("g")) + F.col("row") / 16 + F.col("col") / 64).alias("cost"))


query(
    "assignment_margins",
    lambda s, d: tracking.assignment_margins(peak_costs(s, d)),
    f"""WITH {PEAKS_SQL}, p AS (SELECT recording_id, f_hz, row_number() OVER (PARTITION BY recording_id ORDER BY k) u, row_number() OVER (PARTITION BY recording_id ORDER BY k DESC) v FROM peaks),
    c AS (SELECT a.recording_id, a.u AS "row", b.v AS col, abs(a.f_hz - b.f_hz) + a.u/16.0::DOUBLE + b.v/64.0::DOUBLE AS cost FROM p a JOIN p b ON a.recording_id = b.recording_id),
    o AS (SELECT *, list(cost) OVER (PARTITION BY recording_id, "row") AS lr, list(cost) OVER (PARTITION BY recording_id, col) AS lc FROM c),
    m AS (SELECT recording_id, "row", col, cost, list_sort(lr)[CASE WHEN cost = list_min(lr) THEN 2 ELSE 1 END] - cost AS rm, list_sort(lc)[CASE WHEN cost = list_min(lc) THEN 2 ELSE 1 END] - cost AS cm FROM o)
    SELECT recording_id, "row", col, {r('cost', 'cost')}, {r('rm', 'row_margin')}, {r('cm', 'column_margin')}, {r('least(rm, cm)', 'margin')} FROM m""",
)

# ---- candidates of neighbouring conditions ------------------------------------------

GATE = 0.1


def refs(s, d):
    """All accepted references, their frequencies spread so that most candidates have few partners."""
    return candidate_refs(s, d).filter("accepted").withColumn("frequency_hz", F.round(F.col("frequency_hz") + F.col("candidate_id") * 0.37 % 100, 4))


REFS_SQL = f"{REF_SQL}, rf AS (SELECT * REPLACE (round(frequency_hz + (candidate_id * 0.37::DOUBLE) % 100, 4) AS frequency_hz) FROM ref WHERE accepted)"
COSTS_SQL = f"""{REFS_SQL}, pr AS (SELECT l.label_idx AS pair, l.recording_id AS lower_recording_id, l.candidate_id AS lower_candidate_id, h.recording_id AS higher_recording_id, h.candidate_id AS higher_candidate_id, l.frequency_hz AS lower_hz, h.frequency_hz AS higher_hz,
  abs(l.frequency_hz - h.frequency_hz)/{GATE} + coalesce(0.25*abs(log2(l.tau_s/h.tau_s)), 0) + coalesce(0.25*abs(l.stability - h.stability), 0) AS cost
  FROM rf l JOIN rf h ON h.label_idx = l.label_idx + 1 AND abs(l.frequency_hz - h.frequency_hz) <= {GATE} + 1e-12)"""
PAIR_COLUMNS = f"pair, lower_recording_id, lower_candidate_id, higher_recording_id, higher_candidate_id, {r('lower_hz', 'lower_hz')}, {r('higher_hz', 'higher_hz')}, {r('cost', 'cost')}"


def costs(s, d):
    return association.pair_costs(refs(s, d), GATE)


def best(s, d):
    """Candidates that are each other's cheapest."""
    return association.best_matches(refs(s, d), GATE)


query("pair_costs", costs, f"WITH {COSTS_SQL} SELECT {PAIR_COLUMNS} FROM pr", many=True)
query(
    "mutual_best_matches",
    best,
    f"""WITH {COSTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY pair, lower_candidate_id ORDER BY cost, higher_candidate_id) a, row_number() OVER (PARTITION BY pair, higher_candidate_id ORDER BY cost, lower_candidate_id) b FROM pr WHERE cost <= 1)
    SELECT {PAIR_COLUMNS} FROM k WHERE a = 1 AND b = 1""",
)
for side, name in (("lower", "splits"), ("higher", "merges")):
    query(
        name,
        lambda s, d, side=side: association.close_partners(refs(s, d), side, GATE),
        f"""WITH {COSTS_SQL}, b AS (SELECT *, min(cost) OVER (PARTITION BY pair, {side}_recording_id, {side}_candidate_id) AS best FROM pr WHERE cost <= 1)
        SELECT pair, {side}_recording_id, {side}_candidate_id, count(*) AS partners, {r('min(cost)', 'best_cost')}, {r('max(cost)', 'worst_cost')} FROM b WHERE cost <= best + 0.1 + 1e-12 GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    )
BEST_SQL = f"{COSTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY pair, lower_candidate_id ORDER BY cost, higher_candidate_id) a, row_number() OVER (PARTITION BY pair, higher_candidate_id ORDER BY cost, lower_candidate_id) b FROM pr WHERE cost <= 1), best AS (SELECT * FROM k WHERE a = 1 AND b = 1)"
for side, name, shift in (("lower", "disappearing", 0), ("higher", "emerging", 1)):
    query(
        name,
        lambda s, d, side=side: association.unmatched(refs(s, d), best(s, d), side),
        f"""WITH {BEST_SQL} SELECT label_idx - {shift} AS pair, recording_id, candidate_id, {r('frequency_hz', 'frequency_hz')} FROM rf
        WHERE label_idx - {shift} BETWEEN 0 AND 3 AND NOT EXISTS (SELECT 1 FROM best WHERE pair = rf.label_idx - {shift} AND {side}_candidate_id = rf.candidate_id AND {side}_recording_id = rf.recording_id)""",
    )
query("hungarian_matches", lambda s, d: association.match_rows(near_assignment.assign_refs(refs(s, d), GATE)))


def repeats(s, d):
    """All accepted references."""
    return candidate_refs(s, d).filter("accepted")


query("condition_clusters", lambda s, d: association.cluster_condition(repeats(s, d), 0.05))
query(
    "condition_cluster_summary",
    lambda s, d: association.cluster_summary(association.cluster_condition(repeats(s, d), 0.05), repeats(s, d).groupBy("label_idx").agg(F.count_distinct("recording_id").alias("recordings"))),
)


def best_chains(s, d):
    return association.chains(refs(s, d), best(s, d))


CHAINS_SQL = f"""{BEST_SQL}, walk AS (SELECT label_idx AS s, candidate_id AS c0, candidate_id AS c, 0 AS node_index, NULL::DOUBLE AS cost FROM rf WHERE NOT EXISTS (SELECT 1 FROM best WHERE pair + 1 = rf.label_idx AND higher_candidate_id = rf.candidate_id)
  UNION ALL SELECT s, c0, higher_candidate_id, node_index + 1, best.cost FROM walk JOIN best ON pair = s + node_index AND lower_candidate_id = c),
ids AS (SELECT s, c0, substr(sha1(s || '|' || string_agg(c::VARCHAR, ',' ORDER BY node_index)), 1, 16) AS chain_id FROM walk GROUP BY 1, 2),
nodes AS (SELECT chain_id, node_index, (s + node_index)::INTEGER AS label_idx, rf.recording_id, rf.candidate_id, rf.frequency_hz, cost FROM walk JOIN ids USING (s, c0) JOIN rf ON rf.label_idx = s + node_index AND rf.candidate_id = c)"""
query("chain_nodes", best_chains, f"WITH RECURSIVE {CHAINS_SQL} SELECT chain_id, node_index, label_idx, recording_id, candidate_id, {r('frequency_hz', 'frequency_hz')}, {r('cost', 'cost')} FROM nodes")
query(
    "chains",
    lambda s, d: association.chain_summary(best_chains(s, d), preserved_hz=0.05),
    f"""WITH RECURSIVE {CHAINS_SQL}, n AS (SELECT *, frequency_hz - lag(frequency_hz) OVER (PARTITION BY chain_id ORDER BY node_index) AS step FROM nodes),
    m AS (SELECT chain_id, min(label_idx) a, max(label_idx) b, count(*) c, arg_min(frequency_hz, node_index) f0, arg_max(frequency_hz, node_index) f1, max(abs(step)) ms, count(*) FILTER (WHERE abs(step) <= 0.05) pv, count(*) FILTER (WHERE step > 0.05) u, count(*) FILTER (WHERE step < -0.05) dn, avg(cost) ac, max(cost) mc FROM n GROUP BY 1)
    SELECT chain_id, a AS start_idx, b AS end_idx, c AS node_count, {r('f0', 'initial_hz')}, {r('f1', 'final_hz')}, {r('ms', 'max_step_hz')}, pv AS preserved, u AS up, dn AS down, {r('ac', 'mean_cost')}, {r('mc', 'max_cost')}, {r('f1-f0', 'total_change_hz')},
      c = 5 AS complete, c = 1 AS isolated, a > 0 AS emerging, b < 4 AS disappearing, {r('c/5.0', 'coverage')} FROM m""",
)


# ---- costs and reasons of candidate pairs -------------------------------------------

LIMITS_OF_PAIRS = {
    "absolute_frequency_gate": 0.1,
    "log_frequency_gate": 0.00012,
    "tau_gate": 1.05,
    "maximum_ambiguous_fraction": 0.35,
    "maximum_near_threshold_fraction": 0.22,
    "minimum_assignment_margin": 0.05,
    "cost_above_threshold": 1.1,
}
WEIGHTS_OF_PAIRS = {
    "frequency": 1.0, "frequency_stability": 0.25, "frequency_drift": 0.2, "frequency_fit_rmse": 0.3, "tau": 0.25, "amplitude_fit_quality": 0.5, "ambiguity": 0.15, "near_threshold": 0.35,
    "assignment_margin": 0.1, "impact_evidence": 0.4,
}


def tracked_refs(s, d):
    """The references with figures of their tracks, missing ones among them."""
    k = F.col("candidate_id")
    return refs(s, d).select(
        "*", F.when(k % 4 != 0, (k % 9) / 10).alias("drift_hz"), F.when(k % 3 != 0, (k % 8) / 20).alias("rmse_hz"), F.when(k % 10 != 0, (k % 5) / 10).alias("ambiguous_fraction"),
        F.when(k % 8 != 0, (k % 6) / 20).alias("near_threshold_fraction"), F.when(k % 12 != 0, (k % 7) / 10).alias("assignment_margin"),
    )


_K = "candidate_id"
TRACKED_SQL = f"""{REFS_SQL}, tr AS (SELECT *, CASE WHEN {_K} % 4 <> 0 THEN ({_K} % 9)/10.0::DOUBLE END AS drift_hz, CASE WHEN {_K} % 3 <> 0 THEN ({_K} % 8)/20.0::DOUBLE END AS rmse_hz, CASE WHEN {_K} % 10 <> 0 THEN ({_K} % 5)/10.0::DOUBLE END AS amb,
  CASE WHEN {_K} % 8 <> 0 THEN ({_K} % 6)/20.0::DOUBLE END AS nt, CASE WHEN {_K} % 12 <> 0 THEN ({_K} % 7)/10.0::DOUBLE END AS am FROM rf)"""
query(
    "pair_diagnosis",
    lambda s, d: diagnosis.diagnose(tracked_refs(s, d), LIMITS_OF_PAIRS, WEIGHTS_OF_PAIRS, 0.15),
    f"""WITH {TRACKED_SQL}, pr AS (SELECT l.label_idx AS pair, l.recording_id AS a, l.candidate_id AS b, h.recording_id AS c, h.candidate_id AS d, l.frequency_hz AS f, h.frequency_hz AS g, h.tau_s - l.tau_s AS tau_change, abs(log2(h.tau_s/l.tau_s)) AS tau,
      l.impact_excited = h.impact_excited AS agree, l.amb AS la, h.amb AS ha, l.nt AS ln, h.nt AS hn, l.am AS lm, h.am AS hm, abs(h.frequency_hz - l.frequency_hz)/0.1::DOUBLE AS c1, coalesce(0.25*abs(h.stability - l.stability), 0)::DOUBLE AS c2,
      coalesce(0.2*abs(h.drift_hz - l.drift_hz), 0)::DOUBLE AS c3, coalesce(0.3*abs(h.rmse_hz - l.rmse_hz), 0)::DOUBLE AS c4, coalesce(0.25*abs(log2(h.tau_s/l.tau_s)), 0)::DOUBLE AS c5, coalesce(0.5*abs(h.r_squared - l.r_squared), 0)::DOUBLE AS c6,
      coalesce(0.15*greatest(l.amb, h.amb), 0)::DOUBLE AS c7, coalesce(0.35*greatest(l.nt, h.nt), 0)::DOUBLE AS c8, coalesce(0.1*abs(h.am - l.am), 0)::DOUBLE AS c9, CASE WHEN l.impact_excited <> h.impact_excited THEN 0.4 ELSE 0 END::DOUBLE AS c10
      FROM tr l JOIN tr h ON h.label_idx = l.label_idx + 1 AND abs(l.frequency_hz - h.frequency_hz) <= 0.15 + 1e-12),
    t AS (SELECT *, c1 + c2 + c3 + c4 + c5 + c6 + c7 + c8 + c9 + c10 AS cost FROM pr),
    w AS (SELECT *, CASE WHEN abs(g - f) > 0.1 THEN 'absolute_frequency_gate' WHEN abs(log2(g/f)) > 0.00012 THEN 'log_frequency_gate' WHEN tau > 1.05 THEN 'tau_gate'
      WHEN la IS NULL OR ha IS NULL THEN 'missing_tracking_evidence' WHEN greatest(la, ha) > 0.35 THEN 'maximum_ambiguous_fraction' WHEN ln IS NULL OR hn IS NULL THEN 'missing_tracking_evidence'
      WHEN greatest(ln, hn) > 0.22 THEN 'maximum_near_threshold_fraction' WHEN lm IS NULL OR hm IS NULL THEN 'missing_tracking_evidence' WHEN least(lm, hm) < 0.05 THEN 'minimum_assignment_margin' WHEN cost > 1.1 THEN 'cost_above_threshold' END AS reason FROM t)
    SELECT pair, a AS lower_recording_id, b AS lower_candidate_id, c AS higher_recording_id, d AS higher_candidate_id, {r('g - f', 'change_hz')}, {r('(g - f)/(0.5*(g + f))', 'relative_change')}, {r('tau_change', 'tau_change')}, agree AS impact_compatible,
      {r('c1', 'frequency_cost')}, {r('c2', 'frequency_stability_cost')}, {r('c3', 'frequency_drift_cost')}, {r('c4', 'frequency_fit_rmse_cost')}, {r('c5', 'tau_cost')}, {r('c6', 'amplitude_fit_quality_cost')}, {r('c7', 'ambiguity_cost')},
      {r('c8', 'near_threshold_cost')}, {r('c9', 'assignment_margin_cost')}, {r('c10', 'impact_evidence_cost')}, {r('cost', 'cost')}, reason, reason IS NULL AS admissible FROM w""",
    many=True,
)
query(
    "candidate_eligibility",
    lambda s, d: candidate_refs(s, d).select("recording_id", "candidate_id", diagnosis.ineligible(F.col("accepted"), F.col("impact_excited"), need_impact=True, need_evidence=True).alias("reason")),
    f"WITH {REF_SQL} SELECT recording_id, candidate_id, CASE WHEN NOT accepted THEN 'candidate_rejected_by_policy' WHEN impact_excited IS NULL OR NOT impact_excited THEN 'missing_required_evidence' END AS reason FROM ref",
)


# ---- one-to-one assignment inside experiments ---------------------------------------


def experiment_refs(s, d):
    """The references with figures of their tracks, an experiment for each type."""
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("experiment_id"))
    return tracked_refs(s, d).join(part.hint("merge"), "candidate_id")


def admissible_pairs(s, d):
    return diagnosis.diagnosed_pairs(experiment_refs(s, d), LIMITS_OF_PAIRS, WEIGHTS_OF_PAIRS, 0.15)


_SIDES = [("f", "frequency_hz"), ("t", "tau_s"), ("s", "stability"), ("q", "r_squared"), ("d", "drift_hz"), ("e", "rmse_hz"), ("b", "amb"), ("n", "nt"), ("g", "am"), ("x", "impact_excited")]
_WEIGHT = WEIGHTS_OF_PAIRS
ADMISSIBLE_SQL = f"""{TRACKED_SQL}, ex AS (SELECT tr.*, p_type AS experiment_id FROM tr JOIN part ON p_partkey = candidate_id),
two AS (SELECT l.experiment_id, l.label_idx AS pair, l.recording_id AS lower_recording_id, l.candidate_id AS lower_candidate_id, h.recording_id AS higher_recording_id, h.candidate_id AS higher_candidate_id,
  {", ".join(f"l.{c} AS l{k}, h.{c} AS h{k}" for k, c in _SIDES)} FROM ex l JOIN ex h ON h.experiment_id = l.experiment_id AND h.label_idx = l.label_idx + 1 AND abs(l.frequency_hz - h.frequency_hz) <= 0.15 + 1e-12),
ten AS (SELECT *, abs(hf - lf)/0.1::DOUBLE + coalesce({_WEIGHT["frequency_stability"]}*abs(hs - ls), 0) + coalesce({_WEIGHT["frequency_drift"]}*abs(hd - ld), 0) + coalesce({_WEIGHT["frequency_fit_rmse"]}*abs(he - le), 0)
  + coalesce({_WEIGHT["tau"]}*abs(log2(ht/lt)), 0) + coalesce({_WEIGHT["amplitude_fit_quality"]}*abs(hq - lq), 0) + coalesce({_WEIGHT["ambiguity"]}*greatest(lb, hb), 0) + coalesce({_WEIGHT["near_threshold"]}*greatest(ln, hn), 0)
  + coalesce({_WEIGHT["assignment_margin"]}*abs(hg - lg), 0) + CASE WHEN lx <> hx THEN {_WEIGHT["impact_evidence"]} ELSE 0 END::DOUBLE AS cost FROM two),
adm AS (SELECT * FROM ten WHERE abs(hf - lf) <= 0.1 AND abs(log2(hf/lf)) <= 0.00012 AND coalesce(abs(log2(ht/lt)) <= 1.05, TRUE) AND greatest(lb, hb) <= 0.35 AND lb IS NOT NULL AND hb IS NOT NULL
  AND greatest(ln, hn) <= 0.22 AND ln IS NOT NULL AND hn IS NOT NULL AND least(lg, hg) >= 0.05 AND lg IS NOT NULL AND hg IS NOT NULL AND cost <= 1.1)"""


def prices(s, d):
    pairs = admissible_pairs(s, d)
    return pairs, assignment.assign_nodes(pairs)


query("experiment_matches", lambda s, d: diagnosis.assign_diagnosed(admissible_pairs(s, d), LIMITS_OF_PAIRS["cost_above_threshold"]))
# what proves the assignment least: SQL can't assign, but knows every pair and candidate that the prices must hold for
query(
    "assignment_pair_certificate",
    lambda s, d: assignment.pair_certificate(*prices(s, d)),
    f"WITH {ADMISSIBLE_SQL} SELECT experiment_id, pair, lower_recording_id, lower_candidate_id, higher_recording_id, higher_candidate_id, {r('cost', 'cost')}, TRUE AS not_below_prices, TRUE AS tight_if_matched FROM adm",
)
query(
    "assignment_node_certificate",
    lambda s, d: assignment.node_certificate(prices(s, d)[1]),
    f"""WITH {ADMISSIBLE_SQL}, nd AS (SELECT DISTINCT experiment_id, pair, 'lower' AS side, lower_recording_id AS recording_id, lower_candidate_id AS candidate_id FROM adm
      UNION ALL SELECT DISTINCT experiment_id, pair, 'higher', higher_recording_id, higher_candidate_id FROM adm)
    SELECT *, TRUE AS in_bounds, TRUE AS at_bound_if_left_out, TRUE AS one_mate FROM nd""",
)
# the same over the pairs of three costs and no experiments
query(
    "hungarian_certificate",
    lambda s, d: near_assignment.certificate(refs(s, d), GATE),
    f"WITH {COSTS_SQL} SELECT pair, lower_recording_id, lower_candidate_id, higher_recording_id, higher_candidate_id, {r('cost', 'cost')}, TRUE AS not_below_prices, TRUE AS tight_if_matched FROM pr WHERE cost <= 1",
    many=True,
)


# ---- repeats of a condition, by five costs ------------------------------------------

WITHIN = within.Limits(
    {"absolute_frequency_gate": 0.05, "log_frequency_gate": 0.00007},
    {"frequency": 1.0, "frequency_stability": 2.0, "tau": 0.25, "amplitude_fit_quality": 1.5, "impact_evidence": 0.4},
    maximum_cost=1.6, ambiguity_margin=0.05, minimum_coverage=0.1, maximum_dispersion=0.00002,
)


def repeated(s, d):
    """All accepted references, each in its type's experiment."""
    part = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("experiment_id"))
    return repeats(s, d).join(part.hint("merge"), "candidate_id")  # wide rows in a small file, which the planner would send to the driver


def within_totals(refs):
    return refs.groupBy("experiment_id", "label_idx").agg(F.count_distinct("recording_id").alias("recordings"))


query("within_pairs", lambda s, d: within.compared_pairs(within.associate(repeated(s, d), WITHIN)))
query("within_clusters", lambda s, d: within.cluster_criteria(within.members(within.associate(repeated(s, d), WITHIN, listed=False)), within_totals(repeated(s, d)), WITHIN))


query("within_unmatched", lambda s, d: within.alone_members(within.associate(repeated(s, d), WITHIN, listed=False)))
# SQL can't cluster, but knows every reference that must lie in one cluster, alone of its recording there and within the gates
query(
    "within_invariants",
    lambda s, d: within.invariants(within.members(within.associate(repeated(s, d), WITHIN, listed=False)), WITHIN),
    f"""WITH {REF_SQL} SELECT p_type AS experiment_id, label_idx, recording_id, candidate_id, {r('frequency_hz', 'frequency_hz')}, 1::BIGINT AS clusters, TRUE AS only_one, TRUE AS within_gates
    FROM ref JOIN part ON p_partkey = candidate_id WHERE accepted""",
)
