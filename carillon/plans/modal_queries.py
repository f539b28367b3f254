"""Queries over chains as hypotheses, their parameters and quality factors, and over envelope pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import energy, modal
from ..sources.adapters import SER_SQL, candidate_refs, series
from .association_queries import CHAINS_SQL, best_chains
from .registry import query
from .signal_queries import BINS_SQL, bins, r

# ---- hypotheses ---------------------------------------------------------------------


def nodes(s, d):
    extra = candidate_refs(s, d).select("candidate_id", "tau_s", "coverage", "impact_excited")
    return best_chains(s, d).join(extra.hint("merge"), "candidate_id")


NODES_SQL = f"{CHAINS_SQL}, nd AS (SELECT nodes.*, tau_s, coverage, impact_excited FROM nodes JOIN ref USING (candidate_id))"
EVIDENCE_SQL = f"""{NODES_SQL}, ns AS (SELECT *, frequency_hz - lag(frequency_hz) OVER (PARTITION BY chain_id ORDER BY node_index) AS step, ln(tau_s) AS lt FROM nd),
ev AS (SELECT chain_id, count(*) c, least(1, count(*)/2.0) cov, max(abs(step)) ms, CASE WHEN count(*) > 1 THEN abs(arg_max(frequency_hz, node_index) - arg_min(frequency_hz, node_index)) END tc, stddev_pop(frequency_hz) rm, max(cost) mxc, avg(cost) mc,
  avg(coverage) tr, count(lt) nt, CASE WHEN count(lt) > 1 THEN max(lt) - min(lt) END lr, CASE WHEN count(lt) > 1 THEN stddev_pop(lt) END ls, count(impact_excited) ni, avg(impact_excited::INTEGER) imp FROM ns GROUP BY 1),
up AS (SELECT *, 1 - greatest(0, least(1, ms/2)) u1, 1 - greatest(0, least(1, tc/5)) u2, 1 - greatest(0, least(1, rm)) u3, 1 - greatest(0, least(1, mxc)) a1, 1 - greatest(0, least(1, mc/0.75)) a2, 1 - greatest(0, least(1, lr/0.5)) d1, 1 - greatest(0, least(1, ls/0.25)) d2 FROM ev),
sc AS (SELECT *, CASE WHEN c > 1 THEN (u1+u2+u3)/3 END fs, CASE WHEN mc IS NOT NULL THEN (a1+a2)/2 END acs, least(1, tr/0.8) ts, CASE WHEN nt >= 2 THEN (d1+d2)/2 END ds, CASE WHEN ni > 0 THEN imp END iscore FROM up),
sx AS (SELECT *, (CASE WHEN ts IS NULL THEN 1 ELSE 0 END + CASE WHEN ds IS NULL THEN 1 ELSE 0 END + CASE WHEN iscore IS NULL THEN 1 ELSE 0 END) mi FROM sc),
sy AS (SELECT *, greatest(0, least(1, (cov + coalesce(4*fs, 0) + coalesce(acs, 0) + coalesce(ts, 0) + coalesce(ds, 0) + coalesce(iscore, 0))
  / (1 + CASE WHEN fs IS NULL THEN 0 ELSE 4 END + CASE WHEN acs IS NULL THEN 0 ELSE 1 END + CASE WHEN ts IS NULL THEN 0 ELSE 1 END + CASE WHEN ds IS NULL THEN 0 ELSE 1 END + CASE WHEN iscore IS NULL THEN 0 ELSE 1 END) - 0.05*mi)) score FROM sx)"""


def evidence(s, d):
    return modal.evidence(nodes(s, d), labels=2)


query(
    "hypothesis_frequency",
    lambda s, d: modal.frequency_evidence(evidence(s, d)),
    f"WITH RECURSIVE {EVIDENCE_SQL} SELECT chain_id, {r('ms', 'max_step_hz')}, {r('tc', 'total_change_hz')}, {r('rm', 'trajectory_rmse_hz')}, CASE WHEN c > 1 THEN ms <= 2 END AS step_ok, CASE WHEN c > 1 THEN tc <= 5 END AS total_ok, CASE WHEN c > 1 THEN rm <= 1 END AS rmse_ok, {r('fs', 'frequency_score')} FROM sc",
)
query(
    "hypothesis_decay",
    lambda s, d: modal.decay_evidence(evidence(s, d)),
    f"WITH RECURSIVE {EVIDENCE_SQL} SELECT chain_id, nt AS tau_count, {r('lr', 'log_tau_range')}, {r('ls', 'log_tau_std')}, CASE WHEN nt >= 2 THEN lr <= 0.5 AND ls <= 0.25 END AS consistent, {r('ds', 'decay_score')} FROM sc",
)
query(
    "hypothesis_score",
    lambda s, d: modal.scores(evidence(s, d)).select("chain_id", "coverage_part", "frequency_part", "association_part", "tracking_part", "decay_part", "impact_part", "missing_evidence", "score"),
    f"WITH RECURSIVE {EVIDENCE_SQL} SELECT chain_id, {r('cov', 'coverage_part')}, {r('fs', 'frequency_part')}, {r('acs', 'association_part')}, {r('ts', 'tracking_part')}, {r('ds', 'decay_part')}, {r('iscore', 'impact_part')}, mi AS missing_evidence, {r('score', 'score')} FROM sy",
)
STATUS_SQL = f"""{EVIDENCE_SQL}, hr AS (SELECT *, coalesce((c > 1 AND ms > 2)::INTEGER, 0) + coalesce((c > 1 AND tc > 5)::INTEGER, 0) + coalesce((c > 1 AND rm > 1)::INTEGER, 0) + coalesce((mxc > 1)::INTEGER, 0) + coalesce((mc > 0.75)::INTEGER, 0) + coalesce((nt >= 2 AND NOT (lr <= 0.5 AND ls <= 0.25))::INTEGER, 0) rej,
  mi + coalesce((imp < 0.5)::INTEGER, 0) + coalesce((tr < 0.8)::INTEGER, 0) res FROM sy),
hy AS (SELECT *, CASE WHEN cov < 1 THEN 'rejected' WHEN c < 2 THEN 'insufficient_evidence' WHEN rej > 0 THEN 'rejected' WHEN res > 0 THEN CASE WHEN score >= 0.55 THEN 'accepted_with_reservations' ELSE 'inconclusive' END WHEN score >= 0.75 THEN 'accepted' ELSE 'inconclusive' END status FROM hr)"""
query("hypothesis_status", lambda s, d: modal.hypotheses(evidence(s, d)), f"WITH RECURSIVE {STATUS_SQL} SELECT chain_id, c AS condition_count, {r('score', 'score')}, rej AS rejection_count, res AS reservation_count, status FROM hy")
query(
    "hypothesis_summary",
    lambda s, d: modal.hypotheses(evidence(s, d)).groupBy("status").agg(F.count("*").alias("hypotheses"), F.avg("score").alias("mean_score")),
    f"WITH RECURSIVE {STATUS_SQL} SELECT status, count(*) AS hypotheses, {r('avg(score)', 'mean_score')} FROM hy GROUP BY 1",
)

# ---- parameters ---------------------------------------------------------------------

query(
    "frequency_locations",
    lambda s, d: modal.locations(nodes(s, d)),
    f"""WITH RECURSIVE {NODES_SQL}, wm AS (SELECT chain_id, frequency_hz, sum(coverage) OVER (PARTITION BY chain_id ORDER BY frequency_hz) part, sum(coverage) OVER (PARTITION BY chain_id) tot FROM nd WHERE coverage > 0),
    wz AS (SELECT chain_id, min(frequency_hz) FILTER (WHERE part >= 0.5*tot - 1e-12) w FROM wm GROUP BY 1)
    SELECT chain_id, count(*) AS n, {r('avg(frequency_hz)', 'mean_hz', 5)}, {r('median(frequency_hz)', 'median_hz', 5)}, {r('exp(avg(ln(frequency_hz)))', 'geometric_hz', 5)}, {r('sum(frequency_hz*coverage)/sum(coverage)', 'weighted_mean_hz', 5)},
      {r('CASE WHEN count(*) > 1 THEN stddev_samp(frequency_hz) END', 'std_hz', 5)}, {r('max(frequency_hz)-min(frequency_hz)', 'range_hz', 5)}, {r('stddev_pop(frequency_hz)/avg(frequency_hz)', 'variation', 5)}, {r('any_value(w)', 'weighted_median_hz', 5)} FROM nd JOIN wz USING (chain_id) GROUP BY 1""",
    digits=5,
)
query(
    "node_weights",
    lambda s, d: modal.normalised_weights(nodes(s, d), "tau_s"),
    f"""WITH RECURSIVE {NODES_SQL}, w AS (SELECT chain_id, node_index, coalesce(tau_s, 0) w, sum(coalesce(tau_s, 0)) OVER (PARTITION BY chain_id) t, count(*) OVER (PARTITION BY chain_id) c FROM nd)
    SELECT chain_id, node_index, {r('CASE WHEN t > 0 THEN w/t ELSE 1.0/c END', 'weight')} FROM w""",
)
query(
    "frequency_trajectory",
    lambda s, d: modal.trajectories(nodes(s, d)),
    f"""WITH RECURSIVE {NODES_SQL}, t AS (SELECT chain_id, count(*) n, regr_sxx(frequency_hz, node_index) xx, regr_syy(frequency_hz, node_index) yy, regr_sxy(frequency_hz, node_index) xy, arg_max(frequency_hz, node_index) - arg_min(frequency_hz, node_index) ch FROM nd GROUP BY 1)
    SELECT chain_id, n, {r('ch', 'signed_change_hz', 5)}, {r('CASE WHEN xx > 0 THEN xy/xx END', 'slope_hz_per_step', 5)}, {r('CASE WHEN xx > 0 AND yy > 1e-12 THEN 1 - greatest(0, yy - xy*xy/xx)/yy END', 'r_squared', 5)}, {r('CASE WHEN xx > 0 THEN sqrt(greatest(0, yy - xy*xy/xx)/n) END', 'rmse_hz', 5)} FROM t""",
    digits=5,
)
query(
    "frequency_uncertainty",
    lambda s, d: modal.uncertainties(nodes(s, d)),
    f"""WITH RECURSIVE {NODES_SQL}, m AS (SELECT *, median(frequency_hz) OVER (PARTITION BY chain_id) md FROM nd), u AS (SELECT chain_id, CASE WHEN count(*) > 1 THEN stddev_samp(frequency_hz) END a, CASE WHEN count(*) > 1 THEN stddev_samp(frequency_hz)/sqrt(count(*)) END b, 1.4826*median(abs(frequency_hz - md)) c FROM m GROUP BY 1)
    SELECT chain_id, {r('a', 'std_hz', 5)}, {r('b', 'standard_error_hz', 5)}, {r('c', 'scaled_mad_hz', 5)}, {r('greatest(a, b, c)', 'conservative_hz', 5)} FROM u""",
    digits=5,
)
DECAY_SQL = f"""{NODES_SQL}, dc AS (SELECT chain_id, count(*) n, exp(avg(ln(tau_s))) tau, max(ln(tau_s))-min(ln(tau_s)) lr, stddev_pop(ln(tau_s)) lp, CASE WHEN count(*) > 1 THEN stddev_samp(ln(tau_s)) END ls FROM nd WHERE tau_s > 0 GROUP BY 1)"""
query(
    "decay_parameters",
    lambda s, d: modal.decay(nodes(s, d)),
    f"""WITH RECURSIVE {DECAY_SQL} SELECT chain_id, n AS tau_count, {r('tau', 'tau_s')}, {r('lr', 'log_range')}, {r('lp', 'log_std')}, n >= 2 AND lr <= 0.5 AND lp <= 0.25 AS valid, {r('tau*exp(-ls)', 'lower_s')}, {r('tau*exp(ls)', 'upper_s')},
    {r('1/tau', 'amplitude_rate')}, {r('2/tau', 'energy_rate')}, {r('tau*ln(10)', 'to_minus_20_db_s')}, {r('tau*ln(10)*2', 'to_minus_40_db_s')}, {r('tau*ln(10)*3', 'to_minus_60_db_s')} FROM dc""",
)
def bootstrap_sql(value: str, where: str, of: str, back: str = "m") -> str:
    """200 samples of a chain's values, drawn by md5; ``of`` is the location of a list x of draws."""
    drawn = "list_transform(range(len(v)), lambda i: v[1 + ('0x' || substr(md5('0:' || s || ':' || i), 1, 8))::BIGINT % len(v)])"
    return f"""WITH RECURSIVE {NODES_SQL}, vs AS (SELECT chain_id, list({value} ORDER BY node_index) AS v FROM nd WHERE {where} GROUP BY 1),
      sm AS (SELECT chain_id, list_transform(range(200), lambda s: {of.format(drawn)}) AS b FROM vs),
      bk AS (SELECT chain_id, list_transform(b, lambda m: {back}) AS b FROM sm)
    SELECT chain_id, {r("list_aggregate(b, 'quantile_cont', 0.025)", 'lower')}, {r("list_aggregate(b, 'quantile_cont', 0.975)", 'upper')}, {r("list_aggregate(b, 'stddev_samp')", 'std')} FROM bk"""


_MEAN, _MEDIAN = "list_aggregate({}, 'avg')", "list_aggregate({}, 'median')"
query("frequency_bootstrap", lambda s, d: modal.bootstrap(nodes(s, d)), bootstrap_sql("frequency_hz", "frequency_hz IS NOT NULL", _MEAN))
query("frequency_bootstrap_median", lambda s, d: modal.bootstrap(nodes(s, d), location="median"), bootstrap_sql("frequency_hz", "frequency_hz IS NOT NULL", _MEDIAN))
query("decay_bootstrap", lambda s, d: modal.bootstrap(nodes(s, d), "tau_s", "geometric"), bootstrap_sql("ln(tau_s)", "tau_s > 0", _MEAN, "exp(m)"))
query(
    "parameter_status",
    lambda s, d: modal.parameter_status(modal.hypotheses(evidence(s, d)), modal.locations(nodes(s, d)), modal.decay(nodes(s, d))),
    f"""WITH RECURSIVE {STATUS_SQL}, lc AS (SELECT chain_id, count(*) n, avg(frequency_hz) f, stddev_pop(frequency_hz)/avg(frequency_hz) cv FROM nd GROUP BY 1),
    dc AS (SELECT chain_id, exp(avg(ln(tau_s))) tau, count(*) >= 2 AND max(ln(tau_s))-min(ln(tau_s)) <= 0.5 AND stddev_pop(ln(tau_s)) <= 0.25 ok FROM nd WHERE tau_s > 0 GROUP BY 1)
    SELECT chain_id, {r('f', 'frequency_hz')}, {r('tau', 'tau_s')}, CASE WHEN status IN ('rejected', 'insufficient_evidence', 'inconclusive') OR n < 2 OR cv > 0.02 THEN 'insufficient_evidence' WHEN NOT coalesce(ok, false) THEN 'partial'
      WHEN status = 'accepted_with_reservations' THEN 'valid_with_reservations' ELSE 'valid' END AS parameter_status FROM hy JOIN lc USING (chain_id) LEFT JOIN dc USING (chain_id)""",
)

# ---- quality factors ----------------------------------------------------------------


def decay_params(s, d):
    return candidate_refs(s, d).select("candidate_id", "frequency_hz", "tau_s", (F.col("frequency_hz") * 0.001).alias("frequency_u"), (F.col("tau_s") * 0.05).alias("tau_u"))


query(
    "q_decay",
    lambda s, d: modal.q_from_decay(decay_params(s, d)),
    f"""WITH q AS (SELECT p_partkey AS candidate_id, p_retailprice f, CASE WHEN p_partkey % 7 <> 0 THEN 0.5::DOUBLE + (p_partkey % 13)/10.0::DOUBLE END t FROM part)
    SELECT candidate_id, {r('f', 'frequency_hz', 4)}, {r('t', 'tau_s', 4)}, {r('f*0.001', 'frequency_u', 4)}, {r('t*0.05', 'tau_u', 4)}, {r('pi()*f*t', 'q_decay', 4)}, {r('pi()*f*t*sqrt(pow(0.001, 2)+pow(0.05, 2))', 'q_decay_u', 4)} FROM q""",
    digits=4,
)


def widths(s, d):
    b = bins(s, d)
    return modal.bandwidths(b, b.select("recording_id").distinct().select("recording_id", (F.col("recording_id") % 25 + 4.3).cast("double").alias("target_hz")))


WIDTHS_SQL = f"""{BINS_SQL}, nb AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS h FROM bins WINDOW w AS (PARTITION BY recording_id ORDER BY k)), tg AS (SELECT DISTINCT recording_id, (recording_id % 25 + 4.3)::DOUBLE AS target_hz FROM bins),
tp AS (SELECT nb.*, target_hz FROM nb JOIN tg USING (recording_id) WHERE mag > l AND mag > h QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY abs(f_hz - target_hz), mag DESC, k) = 1),
pk AS (SELECT recording_id, target_hz, k AS pk, f_hz AS peak_hz, mag * pow(10, -3.0/20) AS cut FROM tp),
lf AS (SELECT nb.recording_id, f_hz + (cut - mag)/(h - mag) AS lo FROM nb JOIN pk USING (recording_id) WHERE mag <= cut AND k < pk QUALIFY row_number() OVER (PARTITION BY nb.recording_id ORDER BY k DESC) = 1),
rg AS (SELECT nb.recording_id, f_hz - (cut - mag)/(l - mag) AS hi FROM nb JOIN pk USING (recording_id) WHERE mag <= cut AND k > pk QUALIFY row_number() OVER (PARTITION BY nb.recording_id ORDER BY k) = 1),
bw AS (SELECT recording_id, target_hz, peak_hz, lo, hi, hi - lo AS width, peak_hz/(hi - lo) AS q FROM pk LEFT JOIN lf USING (recording_id) LEFT JOIN rg USING (recording_id))"""
query("bandwidth_crossings", widths, f"WITH {WIDTHS_SQL} SELECT recording_id, {r('target_hz', 'target_hz')}, {r('peak_hz', 'peak_hz')}, {r('lo', 'low_hz')}, {r('hi', 'high_hz')}, {r('width', 'bandwidth_hz')}, {r('q', 'q_bandwidth')} FROM bw")
query(
    "bandwidth_resolution",
    lambda s, d: widths(s, d).select("recording_id", modal.resolution_class(F.col("bandwidth_hz"), F.lit(1.0)).alias("resolution")),
    f"WITH {WIDTHS_SQL} SELECT recording_id, CASE WHEN width IS NULL THEN 'unavailable' WHEN width < 1 THEN 'unresolved' WHEN width < 2 THEN 'resolution_limited' WHEN width < 4 THEN 'marginally_resolved' ELSE 'well_resolved' END AS resolution FROM bw",
)


def both_q(s, d):
    return widths(s, d).select("recording_id", F.when(F.col("recording_id") % 6 != 0, F.col("target_hz") * (F.col("recording_id") % 5 + 1) / 8).alias("q_decay"), "q_bandwidth")


QS_SQL = f"""{WIDTHS_SQL}, qs AS (SELECT recording_id, CASE WHEN recording_id % 6 <> 0 THEN target_hz*(recording_id % 5 + 1)/8 END a, q b FROM bw), qd AS (SELECT *, abs(a-b)/((a+b)/2) rel, abs(ln(a/b)) lg FROM qs),
qc AS (SELECT *, CASE WHEN rel IS NULL THEN 'unavailable' WHEN rel <= 0.2 AND lg <= ln(1.25::DOUBLE) THEN 'consistent' WHEN rel <= 0.4 AND lg <= 2*ln(1.25::DOUBLE) THEN 'partially_consistent' ELSE 'inconsistent' END k FROM qd)"""
Q_COLUMNS = f"recording_id, {r('a', 'q_decay')}, {r('b', 'q_bandwidth')}, {r('rel', 'relative_difference')}, {r('lg', 'log_difference')}, k AS consistency"
query("q_compare", lambda s, d: modal.compare_q(both_q(s, d)), f"WITH {QS_SQL} SELECT {Q_COLUMNS} FROM qc")
query(
    "q_combine",
    lambda s, d: modal.combine_q(modal.compare_q(both_q(s, d))),
    f"""WITH {QS_SQL} SELECT {Q_COLUMNS}, {r("CASE WHEN k = 'consistent' THEN sqrt(a*b) WHEN k = 'unavailable' THEN coalesce(a, b) WHEN k = 'partially_consistent' THEN a END", 'representative_q')}, {r('(a+b)/2', 'arithmetic_q')},
    CASE WHEN a IS NULL AND b IS NULL THEN 'insufficient_evidence' WHEN k = 'inconsistent' THEN 'inconclusive' WHEN k = 'unavailable' THEN 'partial' WHEN k = 'partially_consistent' THEN 'valid_with_reservations' ELSE 'valid' END AS q_status FROM qc""",
)

# ---- energy exchange ----------------------------------------------------------------

STEP = 86400.0


def envelopes(s, d):
    return series(s, d).select(F.col("recording_id").alias("source_id"), "n", "t_s", F.col("x").alias("a"))


def prepared(s, d):
    return energy.prepare(envelopes(s, d))


def grid(s, d):
    return energy.resample(prepared(s, d), STEP)


def pairs(s, d):
    return energy.all_pairs(envelopes(s, d).select((F.floor(F.col("source_id") / 5)).alias("group_id"), "source_id").distinct())


def aligned(s, d):
    return energy.align(grid(s, d), pairs(s, d))


PREP_SQL = f"{SER_SQL}, pp AS (SELECT recording_id AS source_id, n, t_s, x / max(x) OVER (PARTITION BY recording_id) AS a FROM ser)"
GRID_SQL = f"""{PREP_SQL}, sg AS (SELECT source_id, t_s, a, lead(t_s) OVER w AS t1, lead(a) OVER w AS a1 FROM pp WINDOW w AS (PARTITION BY source_id ORDER BY t_s)),
gd AS (SELECT source_id, k AS n, k*{STEP} AS t_s, max(a + (a1-a)*(k*{STEP}-t_s)/(t1-t_s)) AS a FROM sg JOIN (SELECT unnest(range(0, (SELECT floor(max(t_s)/{STEP})::BIGINT + 2 FROM pp))) AS k) ON t1 > t_s AND k >= ceil(t_s/{STEP} - 1e-9) AND k <= floor(t1/{STEP} + 1e-9) GROUP BY 1, 2)"""
ALIGN_SQL = f"""{GRID_SQL}, src AS (SELECT DISTINCT recording_id // 5 AS g, recording_id AS s FROM ser), al AS (SELECT x.s AS source_a, y.s AS source_b, row_number() OVER (PARTITION BY x.s, y.s ORDER BY p.n) - 1 AS n, p.t_s, p.a AS x, q.a AS y, p.a*p.a AS ex, q.a*q.a AS ey
  FROM src x JOIN src y ON x.g = y.g AND x.s < y.s JOIN gd p ON p.source_id = x.s JOIN gd q ON q.source_id = y.s AND q.n = p.n)"""
CORR = "CASE WHEN stddev_pop({0}) > 1e-12 AND stddev_pop({1}) > 1e-12 THEN covar_pop({0}, {1})/(stddev_pop({0})*stddev_pop({1})) END"
query("envelope_prepare", prepared, f"WITH {PREP_SQL} SELECT source_id, n, {r('t_s', 't_s')}, {r('a', 'a')}, {r('a*a', 'energy')} FROM pp")
query("envelope_resample", grid, f"WITH {GRID_SQL} SELECT source_id, n, {r('t_s', 't_s')}, {r('a', 'a')}, {r('a*a', 'energy')} FROM gd")
query("envelope_align", aligned, f"WITH {ALIGN_SQL} SELECT source_a, source_b, n, {r('t_s', 't_s')}, {r('x', 'x')}, {r('y', 'y')}, {r('ex', 'ex')}, {r('ey', 'ey')} FROM al")
TREND_SQL = f"""{ALIGN_SQL}, ad AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM al WINDOW w AS (PARTITION BY source_a, source_b ORDER BY n)),
tr AS (SELECT source_a, source_b, count(*) n, regr_slope(x, t_s) sx, regr_slope(y, t_s) sy, count(*) FILTER (WHERE dx*dy < 0)/count(dx) os FROM ad GROUP BY 1, 2)"""
query(
    "envelope_trends",
    lambda s, d: energy.trends(aligned(s, d)).drop("slope_x", "slope_y"),
    f"""WITH {TREND_SQL} SELECT source_a, source_b, n, {r('os', 'opposed_steps')}, CASE WHEN sx >= 1e-9 THEN 'increasing' WHEN sx <= -1e-9 THEN 'decreasing' ELSE 'stable' END AS trend_x, CASE WHEN sy >= 1e-9 THEN 'increasing' WHEN sy <= -1e-9 THEN 'decreasing' ELSE 'stable' END AS trend_y,
    (sx >= 1e-9 AND sy <= -1e-9) OR (sx <= -1e-9 AND sy >= 1e-9) AS opposed FROM tr""",
)
LAGS = range(-3, 4)
LAG_SQL = f"""{ALIGN_SQL}, lg AS (SELECT p.source_a, p.source_b, lag, count(*) n, {CORR.format('p.x', 'q.y')} AS r FROM al p, range(-3, 4) AS u(lag), al q WHERE q.source_a = p.source_a AND q.source_b = p.source_b AND q.n = p.n + lag GROUP BY 1, 2, 3)"""
query("lag_correlation", lambda s, d: energy.lag_correlations(aligned(s, d), LAGS).withColumn("lag", F.col("lag").cast("long")), f"WITH {LAG_SQL} SELECT source_a, source_b, lag, n, {r('r', 'r')} FROM lg")
BESTNEG_SQL = f"{LAG_SQL}, bn AS (SELECT source_a, source_b, max(r) FILTER (WHERE lag = 0) z, arg_min(lag, (round(r, 12), abs(lag), lag)) bl, arg_min(r, (round(r, 12), abs(lag), lag)) br FROM lg WHERE r IS NOT NULL GROUP BY 1, 2)"
query("best_negative_lag", lambda s, d: energy.best_negative(energy.lag_correlations(aligned(s, d), LAGS)).withColumn("best_lag", F.col("best_lag").cast("long")), f"WITH {BESTNEG_SQL} SELECT source_a, source_b, {r('z', 'zero_lag_r')}, bl AS best_lag, {r('br', 'best_r')} FROM bn")
query(
    "spearman",
    lambda s, d: energy.spearman(aligned(s, d)),
    f"""WITH {ALIGN_SQL}, rk AS (SELECT source_a, source_b, rank() OVER (PARTITION BY source_a, source_b ORDER BY x) + (count(*) OVER (PARTITION BY source_a, source_b, x) - 1)/2.0 AS rx, rank() OVER (PARTITION BY source_a, source_b ORDER BY y) + (count(*) OVER (PARTITION BY source_a, source_b, y) - 1)/2.0 AS ry FROM al)
    SELECT source_a, source_b, {r(CORR.format('rx', 'ry'), 'rho')} FROM rk GROUP BY 1, 2""",
)
query(
    "circular_shift_test",
    lambda s, d: energy.shift_test(aligned(s, d)),
    f"""WITH {ALIGN_SQL}, sz AS (SELECT source_a, source_b, count(*) c FROM al GROUP BY 1, 2), sh AS (SELECT p.source_a, p.source_b, s, {CORR.format('p.x', 'q.y')} AS r FROM al p JOIN sz USING (source_a, source_b), (SELECT unnest(range(0, (SELECT max(c) FROM sz))) AS s), al q
      WHERE s < c AND q.source_a = p.source_a AND q.source_b = p.source_b AND q.n = (p.n + s) % c GROUP BY 1, 2, 3), ob AS (SELECT source_a, source_b, r AS o FROM sh WHERE s = 0)
    SELECT source_a, source_b, {r('o', 'observed')}, {r('avg((r <= o + 1e-9)::INTEGER)', 'p_value')}, count(*) AS shifts FROM sh JOIN ob USING (source_a, source_b) GROUP BY source_a, source_b, o""",
)
query(
    "block_permutation_test",
    lambda s, d: energy.block_permutation_test(aligned(s, d)),
    f"""WITH {ALIGN_SQL}, sz AS (SELECT source_a, source_b, count(*) AS c, {CORR.format('x', 'y')} AS o FROM al GROUP BY 1, 2),
      bl AS (SELECT c, turn, blk, row_number() OVER (PARTITION BY c, turn ORDER BY md5('0:' || turn || ':' || blk)) AS place FROM (SELECT DISTINCT c, (c + 2) // 3 AS k FROM sz) z, range(19) t(turn), range((SELECT (max(c) + 2) // 3 FROM sz)) b(blk) WHERE blk < k),
      mv AS (SELECT p.source_a, p.source_b, turn, p.y, row_number() OVER (PARTITION BY p.source_a, p.source_b, turn ORDER BY place, p.n) - 1 AS n FROM al p JOIN sz USING (source_a, source_b) JOIN bl ON bl.c = sz.c AND bl.blk = p.n // 3),
      rs AS (SELECT source_a, source_b, turn, {CORR.format('p.x', 'mv.y')} AS r FROM mv JOIN al p USING (source_a, source_b, n) GROUP BY 1, 2, 3)
    SELECT source_a, source_b, {r('o', 'observed')}, {r('CASE WHEN o IS NOT NULL AND c >= 4 THEN (1 + count(*) FILTER (WHERE r <= o + 1e-9))/20.0 END', 'p_value')}, CASE WHEN o IS NOT NULL AND c >= 4 THEN 19 ELSE 0 END AS permutations
    FROM sz LEFT JOIN rs USING (source_a, source_b) GROUP BY source_a, source_b, o, c""",
)
GROWTH_SQL = f"{GRID_SQL}, gw AS (SELECT source_id, a - min(a) OVER (PARTITION BY source_id ORDER BY n) AS g, max(a) OVER (PARTITION BY source_id) AS top FROM gd), gf AS (SELECT source_id, max(g)/max(top) AS f FROM gw GROUP BY 1)"
query("delayed_growth", lambda s, d: energy.delayed_growth(grid(s, d), 0.5), f"WITH {GROWTH_SQL} SELECT source_id, {r('f', 'growth_fraction')}, coalesce(f >= 0.5, false) AS supported FROM gf")
RECOVERY_SQL = f"""{GRID_SQL}, rs AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY n) - 1 AS i, n, a, count(*) OVER (PARTITION BY source_id) AS c FROM gd), lo AS (SELECT source_id, a AS low, n AS m FROM rs WHERE n < floor(c*2/3) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY a, n) = 1),
rv AS (SELECT source_id, low, max(a) FILTER (WHERE n <= m) AS bf, max(a) FILTER (WHERE n > m) AS af FROM rs JOIN lo USING (source_id) GROUP BY 1, 2)"""
query("recovery", lambda s, d: energy.recovery(grid(s, d)), f"WITH {RECOVERY_SQL} SELECT source_id, {r('low', 'low')}, {r('bf', 'before')}, {r('af', 'after')}, {r('(af-low)/nullif(bf-low, 0)', 'recovery_fraction')}, coalesce((af-low)/nullif(bf-low, 0) >= 0.15, false) AS supported FROM rv")
PAIRE_SQL = f"""{ALIGN_SQL}, pe AS (SELECT source_a, source_b, ex+ey AS e, avg(ex+ey) OVER (PARTITION BY source_a, source_b) AS m FROM al), pz AS (SELECT source_a, source_b, m, stddev_pop(e) sd, (max(e)-min(e))/m rr, avg((abs(e-m) <= 0.35*m)::INTEGER) sf FROM pe GROUP BY 1, 2, 3)"""
query("pair_energy", lambda s, d: energy.pair_energy(aligned(s, d)), f"WITH {PAIRE_SQL} SELECT source_a, source_b, {r('m', 'mean')}, {r('sd', 'std')}, {r('rr', 'relative_range')}, {r('sd/m', 'variation')}, {r('sf', 'stable_fraction')}, rr <= 0.35 OR sf >= 0.7 AS conserved FROM pz")
DOM_SQL = f"""{ALIGN_SQL}, dl AS (SELECT source_a, source_b, n, last_value(CASE WHEN x >= 1.05*y THEN 'a' WHEN y >= 1.05*x THEN 'b' END IGNORE NULLS) OVER (PARTITION BY source_a, source_b ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ld FROM al),
dn AS (SELECT *, lag(ld) OVER (PARTITION BY source_a, source_b ORDER BY n) AS bf FROM dl), dz AS (SELECT source_a, source_b, count(*) FILTER (WHERE ld <> bf) sw, count(*) FILTER (WHERE ld = 'a') pa, count(*) FILTER (WHERE ld = 'b') pb FROM dn GROUP BY 1, 2)"""
query("dominance", lambda s, d: energy.dominance(aligned(s, d)), f"WITH {DOM_SQL} SELECT source_a, source_b, sw AS switches, pa AS a_points, pb AS b_points, sw >= 2 AS alternating FROM dz")
PERIOD_SQL = f"{GRID_SQL}, mx AS (SELECT source_id, t_s FROM (SELECT *, lag(a) OVER w AS l, lead(a) OVER w AS h FROM gd WINDOW w AS (PARTITION BY source_id ORDER BY n)) WHERE a >= l AND a > h), mg AS (SELECT source_id, t_s - lag(t_s) OVER (PARTITION BY source_id ORDER BY t_s) AS g FROM mx), mp AS (SELECT source_id, median(g) AS period, count(*) AS c FROM mg GROUP BY 1)"
query("modulation_period", lambda s, d: energy.modulation_period(grid(s, d)), f"WITH {PERIOD_SQL} SELECT source_id, {r('period', 'period_s')}, c AS maxima FROM mp")



def levels(s, d):
    """The series in steps of a tenth of their peak: with plateaus."""
    return grid(s, d).withColumn("a", F.round("a", 1))


query(
    "modulation_period_plateaus",
    lambda s, d: energy.modulation_period(levels(s, d)),
    f"WITH {PERIOD_SQL.replace('FROM gd WINDOW', 'FROM (SELECT * REPLACE (round(a, 1) AS a) FROM gd) WINDOW')} SELECT source_id, {r('period', 'period_s')}, c AS maxima FROM mp",
)


def beats(s, d):
    period = energy.modulation_period(grid(s, d)).select(F.col("source_id").alias("source_a"), (F.col("period_s") / 86400).alias("period_s"))
    return energy.beating(pairs(s, d).select("*", (F.col("source_a") * 0.5).cast("double").alias("fa"), (F.col("source_b") * 0.63).cast("double").alias("fb")).join(period, "source_a"), tolerance=0.9)


BEAT_SQL = f"{PERIOD_SQL}, src AS (SELECT DISTINCT recording_id // 5 AS g, recording_id AS s FROM ser), bt AS (SELECT x.s AS source_a, y.s AS source_b, abs(x.s*0.5::DOUBLE - y.s*0.63::DOUBLE) AS ap, period/86400 AS pd FROM src x JOIN src y ON x.g = y.g AND x.s < y.s JOIN mp ON mp.source_id = x.s), bp AS (SELECT *, 1/nullif(ap, 0) AS ex, coalesce(ap <= 5 AND abs(pd - 1/nullif(ap, 0)) <= 0.9/nullif(ap, 0), false) AS pb FROM bt)"
query("beating", beats, f"WITH {BEAT_SQL} SELECT source_a, source_b, {r('ap', 'separation_hz')}, {r('ex', 'expected_s')}, {r('pd', 'period_s')}, pb AS possible_beating FROM bp")


def exchange(s, d):
    a = aligned(s, d)
    keys = energy.PAIR
    growth = energy.delayed_growth(grid(s, d), 0.5).select("source_id", F.col("supported").alias("g"))
    back = energy.recovery(grid(s, d)).select("source_id", F.col("supported").alias("v"))
    parts = energy.trends(a).select(*keys, F.coalesce("opposed", F.lit(False)).alias("opposed")).join(energy.best_negative(energy.lag_correlations(a, LAGS)), keys, "left")
    parts = parts.join(energy.dominance(a).select(*keys, "alternating"), keys).join(energy.pair_energy(a).select(*keys, "conserved"), keys).join(beats(s, d).select(*keys, "possible_beating"), keys, "left")
    for side in ("a", "b"):
        parts = parts.join(growth.join(back, "source_id").select(F.col("source_id").alias(f"source_{side}"), F.col("g").alias(f"g{side}"), F.col("v").alias(f"v{side}")), f"source_{side}")
    parts = parts.select(
        *keys, "opposed", F.coalesce(F.col("zero_lag_r") <= -0.2, F.lit(False)).alias("negative"), F.coalesce(F.col("best_r") <= -0.3, F.lit(False)).alias("lagged"), (F.col("ga") | F.col("gb")).alias("growth"), (F.col("va") | F.col("vb")).alias("recovery"),
        "alternating", "conserved", F.lit(True).alias("tracking"), "zero_lag_r", F.coalesce("possible_beating", F.lit(False)).alias("possible_beating"),
    )
    return energy.exchange_score(parts).select(*keys, "opposed", "negative", "growth", "recovery", "possible_beating", "score", "status")


EXCHANGE_SQL = f"""WITH {ALIGN_SQL}, {TREND_SQL[len(ALIGN_SQL) + 2:]}, {BESTNEG_SQL[len(ALIGN_SQL) + 2:]}, {DOM_SQL[len(ALIGN_SQL) + 2:]}, {PAIRE_SQL[len(ALIGN_SQL) + 2:]}, {GROWTH_SQL[len(GRID_SQL) + 2:]}, {RECOVERY_SQL[len(GRID_SQL) + 2:]}, {PERIOD_SQL[len(GRID_SQL) + 2:]},
bt AS (SELECT x.s AS source_a, y.s AS source_b, abs(x.s*0.5::DOUBLE - y.s*0.63::DOUBLE) AS ap, period/86400 AS pd FROM src x JOIN src y ON x.g = y.g AND x.s < y.s JOIN mp ON mp.source_id = x.s), bp AS (SELECT *, coalesce(ap <= 5 AND abs(pd - 1/nullif(ap, 0)) <= 0.9/nullif(ap, 0), false) AS pb FROM bt),
sp AS (SELECT gf.source_id, coalesce(f >= 0.5, false) AS g, coalesce((af-low)/nullif(bf-low, 0) >= 0.15, false) AS v FROM gf JOIN rv USING (source_id)),
pt AS (SELECT source_a, source_b, coalesce((sx >= 1e-9 AND sy <= -1e-9) OR (sx <= -1e-9 AND sy >= 1e-9), false) AS op, z, coalesce(z <= -0.2, false) AS ng, coalesce(br <= -0.3, false) AS la, i.g OR j.g AS gr, i.v OR j.v AS rc, sw >= 2 AS al, rr <= 0.35 OR sf >= 0.7 AS co, coalesce(bp.pb, false) AS pb
  FROM tr LEFT JOIN bn USING (source_a, source_b) JOIN dz USING (source_a, source_b) JOIN pz USING (source_a, source_b) LEFT JOIN bp USING (source_a, source_b) JOIN sp i ON i.source_id = source_a JOIN sp j ON j.source_id = source_b),
sc AS (SELECT *, greatest(0, least(1, (op::INTEGER + ng::INTEGER + 0.75::DOUBLE*la::INTEGER + 0.75::DOUBLE*gr::INTEGER + 0.5::DOUBLE*rc::INTEGER + 0.5::DOUBLE*al::INTEGER + 0.5::DOUBLE*co::INTEGER + 0.25::DOUBLE - CASE WHEN z IS NULL THEN 0.05 ELSE 0 END - CASE WHEN gr THEN 0 ELSE 0.05 END - CASE WHEN pb THEN 0.2 ELSE 0 END)/5.25::DOUBLE)) AS score FROM pt)
SELECT source_a, source_b, op AS opposed, ng AS negative, gr AS growth, rc AS recovery, pb AS possible_beating, {r('score', 'score')}, CASE WHEN z IS NULL THEN 'insufficient_evidence' WHEN NOT op THEN 'not_supported' WHEN NOT ng THEN 'inconclusive'
  WHEN score >= 0.6 THEN CASE WHEN pb THEN 'supported_with_reservations' ELSE 'supported' END WHEN score >= 0.4 THEN 'inconclusive' ELSE 'not_supported' END AS status FROM sc"""
query("energy_exchange", exchange, EXCHANGE_SQL)
