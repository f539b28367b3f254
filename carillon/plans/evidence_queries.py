"""Queries over counts, reasons, contexts, limitations and scenarios, and over what figures show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import METRIC_BEGINNINGS, METRIC_NAMES, frequency_change, recognised_metric
from ..operators import association, export, regimes, spectrum, summaries, temporal, validation, views
from ..sources import synthetic
from ..sources.adapters import RATE, REF_SQL, candidate_refs, label_of, series, signals
from . import association_queries as aq
from . import comparison_queries as cq
from . import modal_queries as mq
from .association_queries import BEST_SQL, CHAINS_SQL, COSTS_SQL, POINTS_SQL, best_chains, costs, points, refs
from .registry import ORACLE_SQL, QUERIES, query
from .signal_queries import BINS_SQL, FRAMES_SQL, NOISE_SQL, PEAKS_SQL, bins, frames, r

# ---- summaries ----------------------------------------------------------------------

query(
    "chain_counts",
    lambda s, d: summaries.chain_counts(association.chain_summary(best_chains(s, d), preserved_hz=0.05)),
    f"""WITH c AS ({ORACLE_SQL['chains']}) SELECT count(*) AS chain_count, count(*) FILTER (WHERE complete) AS complete_chain_count, count(*) FILTER (WHERE NOT complete AND node_count > 1) AS partial_chain_count, count(*) FILTER (WHERE node_count = 1) AS singleton_chain_count,
    count(*) FILTER (WHERE emerging) AS emerging_chain_count, count(*) FILTER (WHERE disappearing) AS disappearing_chain_count, sum(node_count)::BIGINT AS candidate_count, coalesce(sum(node_count) FILTER (WHERE node_count > 1), 0)::BIGINT AS matched_candidate_count FROM c""",
)


def _counts(base: str, status: str, names: tuple[str, ...]) -> str:
    return f"WITH c AS ({ORACLE_SQL[base]}) SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {status} = '{n}') AS {n}_count" for n in names) + " FROM c"


for name, base, status, names in (
    ("parameter_counts", "parameter_status", "parameter_status", summaries.PARAMETER_STATUSES),
    ("q_counts", "q_combine", "q_status", summaries.Q_STATUSES),
    ("exchange_counts", "energy_exchange", "status", summaries.EXCHANGE_STATUSES),
    ("validation_counts", "frequency_errors", "status", summaries.VALIDATION_STATUSES),
):
    query(name, lambda s, d, b=base, c=status, n=names: summaries.status_summary(QUERIES[b](s, d), c, n), _counts(base, status, names))

query(
    "parameter_provenance",
    lambda s, d: summaries.provenance(best_chains(s, d), "fixed"),
    f"""WITH RECURSIVE {CHAINS_SQL}, p AS (SELECT chain_id, count(*) AS sources, string_agg(label_idx::VARCHAR, ',' ORDER BY node_index) AS label_idx, string_agg(recording_id, ',' ORDER BY node_index) AS recording_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY node_index) AS candidate_id FROM nodes GROUP BY 1)
    SELECT *, substr(sha256('fixed|' || chain_id || '|' || candidate_id), 1, 16) AS provenance_id FROM p""",
)
query(
    "sequence_problems",
    lambda s, d: summaries.sequence_problems(
        costs(s, d).select(F.col("pair").alias("lower_idx"), (F.col("pair") + 1 + F.when(F.col("lower_candidate_id") % 1000 == 7, 1).otherwise(0)).cast("int").alias("higher_idx")).filter("lower_idx <> 2").distinct(), 5
    ),
    f"""WITH {COSTS_SQL}, q AS (SELECT DISTINCT pair::INTEGER AS lower_idx, (pair + 1 + CASE WHEN lower_candidate_id % 1000 = 7 THEN 1 ELSE 0 END)::INTEGER AS higher_idx FROM pr WHERE pair <> 2), w AS (SELECT i::INTEGER AS lower_idx, (i + 1)::INTEGER AS higher_idx FROM range(0, 4) AS t(i))
    SELECT *, 'not_adjacent' AS problem FROM q WHERE higher_idx <> lower_idx + 1 UNION ALL SELECT *, 'missing_pair' FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.lower_idx = w.lower_idx AND q.higher_idx = w.higher_idx)""",
)

# ---- reasons and contexts -----------------------------------------------------------

for side, shift, other in (("lower", 0, "higher"), ("higher", 1, "lower")):

    def reasons(s, d, side=side):
        found = aq.best(s, d).withColumn("ambiguous", (F.col("pair") == 3) & (F.col("cost") <= 0.01))
        return summaries.unmatched_reasons(refs(s, d), association.pair_costs(refs(s, d), aq.GATE), found, side, 0.5, ("tau_s",))

    query(
        f"unmatched_reasons_{side}",
        reasons,
        f"""WITH {BEST_SQL}, vague AS (SELECT DISTINCT pair FROM best WHERE pair = 3 AND cost <= 0.01), own AS (SELECT label_idx - {shift} AS pair, recording_id, candidate_id, tau_s IS NULL AS mine FROM rf WHERE label_idx - {shift} BETWEEN 0 AND 3),
        seen AS (SELECT pr.pair, {side}_recording_id AS recording_id, {side}_candidate_id AS candidate_id, bool_or(cost > 0.5) AS dear, bool_or(o.tau_s IS NULL) AS gaps FROM pr JOIN rf o ON o.candidate_id = {other}_candidate_id GROUP BY 1, 2, 3)
        SELECT own.pair, own.recording_id, own.candidate_id, CASE WHEN NOT EXISTS (SELECT 1 FROM rf z WHERE z.label_idx - {1 - shift} = own.pair) THEN 'insufficient_data' WHEN EXISTS (SELECT 1 FROM vague WHERE vague.pair = own.pair) THEN 'ambiguous_match' WHEN seen.dear IS NULL THEN 'no_candidate_in_frequency_range'
          WHEN gaps OR mine THEN 'missing_required_evidence' WHEN dear THEN 'cost_above_threshold' ELSE 'no_compatible_candidate' END AS reason
        FROM own LEFT JOIN seen USING (pair, recording_id, candidate_id) WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.pair = own.pair AND {side}_recording_id = own.recording_id AND {side}_candidate_id = own.candidate_id)""",
    )


def impact_pairs(s, d):
    """Best matches with both sides' impact evidence and a class of each, here by coverage."""
    one = candidate_refs(s, d).select("candidate_id", "impact_excited", F.when(F.col("coverage") < 0.8, "weak").otherwise("strong").alias("kind"))
    low, high = (one.select(F.col("candidate_id").alias(f"{n}_candidate_id"), F.col("impact_excited").alias(f"{n}_i"), F.col("kind").alias(f"{n}_k")) for n in ("lower", "higher"))
    j = aq.best(s, d).join(low.hint("merge"), "lower_candidate_id").join(high.hint("merge"), "higher_candidate_id")
    return j.select("pair", "lower_candidate_id", "higher_candidate_id", summaries.impact_compatible(F.col("lower_i"), F.col("higher_i"), F.col("lower_k"), F.col("higher_k")).alias("compatible"))


query(
    "impact_compatibility",
    impact_pairs,
    f"""WITH {BEST_SQL}, kn AS (SELECT candidate_id, impact_excited AS i, CASE WHEN coverage < 0.8 THEN 'weak' ELSE 'strong' END AS c FROM ref)
    SELECT pair, lower_candidate_id, higher_candidate_id, CASE WHEN l.i IS NOT NULL AND h.i IS NOT NULL THEN l.i = h.i OR l.c = h.c END AS compatible FROM best JOIN kn l ON l.candidate_id = lower_candidate_id JOIN kn h ON h.candidate_id = higher_candidate_id""",
)
_CLOSE = "c{0} AS (SELECT pair, {0}_recording_id AS rid, {0}_candidate_id AS cid FROM (SELECT *, min(cost) OVER (PARTITION BY pair, {0}_recording_id, {0}_candidate_id) AS lowest FROM pr WHERE cost <= 1) WHERE cost <= lowest + 0.1 + 1e-12 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"
query(
    "structural_context",
    lambda s, d: summaries.structural_context(best_chains(s, d), association.close_partners(refs(s, d), "lower", aq.GATE), association.close_partners(refs(s, d), "higher", aq.GATE), reject_merge=True),
    f"""WITH RECURSIVE {CHAINS_SQL}, {_CLOSE.format('lower')}, {_CLOSE.format('higher')}, x AS (SELECT chain_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM clower c WHERE c.pair = n.label_idx AND c.rid = n.recording_id AND c.cid = n.candidate_id)) AS a, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM chigher c WHERE c.pair + 1 = n.label_idx AND c.rid = n.recording_id AND c.cid = n.candidate_id)) AS b FROM nodes n GROUP BY 1)
    SELECT chain_id, a AS split_context_count, b AS merge_context_count, b = 0 AS passes, a > 0 AND b = 0 AS requires_reservation FROM x""",
)
query(
    "metric_names",
    lambda s, d: cq.regime_metrics(s, d).select("metric").distinct().withColumn("recognised", recognised_metric(F.col("metric"))),
    f"""WITH {cq.REGIME_SQL} SELECT DISTINCT metric, metric IN ({', '.join(f"'{m}'" for m in METRIC_NAMES)}) OR regexp_matches(metric, '^({"|".join(METRIC_BEGINNINGS)})') AS recognised FROM rm""",
)
query(
    "window_coverage",
    lambda s, d: summaries.window_coverage(points(s, d).join(aq.hits(s, d), "recording_id"), ["recording_id", "track_id"], F.col("hit_s") - 400000.0, F.col("hit_s")),
    f"""WITH {POINTS_SQL}, h AS (SELECT recording_id, max(t_s)/2 AS hit FROM ser GROUP BY 1), w AS (SELECT pt.recording_id, track_id, count(*) FILTER (WHERE t_s BETWEEN hit - 400000 AND hit) AS n, (max(t_s) FILTER (WHERE t_s BETWEEN hit - 400000 AND hit) - min(t_s) FILTER (WHERE t_s BETWEEN hit - 400000 AND hit))/400000 AS p FROM pt JOIN h USING (recording_id) GROUP BY 1, 2)
    SELECT recording_id, track_id, n AS points, {r('CASE WHEN n >= 2 THEN least(1, greatest(0, p)) ELSE 0 END', 'coverage')} FROM w""",
)
BANDS = [("low", 0.0, 10.0), ("middle", 10.0, 20.0), ("high", 20.0, 64.0)]
query(
    "band_summaries",
    lambda s, d: summaries.band_summaries(frames(s, d), BANDS, 0.3),
    f"""WITH {FRAMES_SQL}, bd(band, lo, hi) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in BANDS)}), e AS (SELECT recording_id, frame, any_value(t_s) AS t_s, band, sum(CASE WHEN f_hz >= lo AND f_hz < hi THEN mag*mag ELSE 0 END) AS energy, sum(mag*mag) AS al FROM fb, bd GROUP BY recording_id, frame, band), x AS (SELECT *, energy/al AS fr FROM e WHERE al > 0)
    SELECT recording_id, band, {r('arg_min(energy, frame)', 'initial_energy')}, {r('arg_max(energy, frame)', 'final_energy')}, {r('max(energy)', 'maximum_energy')}, {r('arg_min(fr, frame)', 'initial_fraction')}, {r('arg_max(fr, frame)', 'final_fraction')}, {r('regr_slope(fr, t_s)', 'fraction_slope')},
      {r('avg((fr >= 0.3)::INTEGER)', 'coverage')}, {r('min(t_s) FILTER (WHERE fr < 0.3)', 'below_s')} FROM x GROUP BY 1, 2""",
)


def q_inputs(s, d):
    k = F.col("candidate_id")
    return candidate_refs(s, d).select(
        "candidate_id", "frequency_hz", (0.5 + (k % 7) / 10).alias("bandwidth_hz"), F.when(k % 5 != 0, (k % 3) / 10).cast("double").alias("frequency_u"), F.when(k % 4 != 0, 0.05 + (k % 6) / 100).alias("bandwidth_u")
    )


query(
    "bandwidth_q_uncertainty",
    lambda s, d: summaries.bandwidth_q_uncertainty(q_inputs(s, d)),
    f"""WITH x AS (SELECT p_partkey AS candidate_id, p_retailprice AS f, 0.5::DOUBLE + (p_partkey % 7)/10.0::DOUBLE AS b, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 3)/10.0::DOUBLE END AS uf, CASE WHEN p_partkey % 4 <> 0 THEN 0.05::DOUBLE + (p_partkey % 6)/100.0::DOUBLE END AS ub FROM part), y AS (SELECT *, f/b AS q, sqrt(pow(uf/f, 2) + pow(ub/b, 2)) AS rel FROM x)
    SELECT candidate_id, {r('f', 'frequency_hz')}, {r('b', 'bandwidth_hz')}, {r('uf', 'frequency_u')}, {r('ub', 'bandwidth_u')}, {r('q', 'q_bandwidth')}, {r('q*rel', 'q_u')}, {r('CASE WHEN rel IS NOT NULL THEN greatest(0, q - q*rel) END', 'q_low')}, {r('q + q*rel', 'q_high')}, {r('rel', 'q_relative_u')} FROM y""",
)


def targets(s, d):
    return signals(s, d).select("recording_id").distinct().select("recording_id", (4.3 + F.col("recording_id") % 23).cast("double").alias("target_hz"))


query(
    "nearest_peaks",
    lambda s, d: summaries.nearest_peaks(targets(s, d), spectrum.peaks(bins(s, d))),
    f"""WITH {PEAKS_SQL}, tg AS (SELECT DISTINCT recording_id, 4.3::DOUBLE + recording_id % 23 AS target FROM sig) SELECT recording_id, {r('target', 'target_hz')}, {r('f_hz', 'peak_hz')}, {r('abs(f_hz - target)', 'apart_hz')} FROM tg LEFT JOIN peaks USING (recording_id) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(abs(f_hz - target), 9), f_hz) = 1""",
)
query("peak_bandwidths", lambda s, d: summaries.peak_bandwidths(targets(s, d), spectrum.peaks(bins(s, d)), 1.0))
query(
    "bandwidth_sources",
    lambda s, d: summaries.first_sources(best_chains(s, d), signals(s, d).filter("label_idx <> 1")),
    f"WITH RECURSIVE {CHAINS_SQL} SELECT chain_id, min(label_idx) AS source_idx FROM nodes WHERE label_idx IN (SELECT label % 5 FROM embeddings WHERE label % 5 <> 1) GROUP BY 1",
)

# ---- quality and status -------------------------------------------------------------


def replicate_parts(s, d):
    x = signals(s, d)
    clip = x.groupBy("recording_id").agg(F.avg((F.abs("x") >= 0.35).cast("double")).alias("clipping_fraction"), (F.count("*") / RATE).alias("duration_s"))
    k = F.col("recording_id")
    return clip.join(temporal.signal_to_noise(x, 16).select("recording_id", "snr_db"), "recording_id").select(
        "recording_id", "clipping_fraction", "duration_s", "snr_db", F.when(k % 4 != 1, (k % 7) / 7).alias("tracking_coverage"), F.when(k % 3 != 2, (k % 5) / 5).alias("accepted_fraction")
    )


query(
    "replicate_quality",
    lambda s, d: summaries.replicate_quality(replicate_parts(s, d), 1.5),
    f"""WITH {NOISE_SQL}, rm AS (SELECT recording_id, sqrt(avg(x*x)) AS rms FROM sig GROUP BY 1), z AS (SELECT recording_id, 20*log10(rms/noise_rms) AS snr_db FROM rm JOIN nf USING (recording_id)), m AS (SELECT recording_id, avg((abs(x) >= 0.35)::INTEGER) AS cf, count(*)/{RATE}.0::DOUBLE AS du FROM sig GROUP BY 1),
    q AS (SELECT recording_id, cf, 1 - cf AS a, least(1, greatest(0, du/1.5::DOUBLE)) AS b, least(1, greatest(0, snr_db/60)) AS c, CASE WHEN recording_id % 4 <> 1 THEN (recording_id % 7)/7.0::DOUBLE END AS e, CASE WHEN recording_id % 3 <> 2 THEN (recording_id % 5)/5.0::DOUBLE END AS f, du FROM m JOIN z USING (recording_id))
    SELECT recording_id, {r('a', 'not_clipped')}, {r('b', 'duration_quality')}, {r('c', 'snr_quality')}, {r('(a + b + c + coalesce(e, 0) + coalesce(f, 0))/(3 + (e IS NOT NULL)::INTEGER + (f IS NOT NULL)::INTEGER)', 'quality')}, cf > 0 AS clipping_present, du < 1.5 AS short_duration FROM q""",
)


def stage_rows(s, d):
    """Stages of one experiment for each user: a status for each kind of event."""
    k = F.col("recording_id") * 7 + F.col("label_idx") * 3
    status = F.when(k % 53 == 0, "failed").when(k % 47 == 0, "blocked").when(k % 29 == 0, "insufficient_evidence").when(k % 11 == 0, "completed_with_reservations").otherwise("completed")
    rows = series(s, d).select("recording_id", "label_idx").distinct()
    return rows.select(F.col("recording_id").alias("experiment_id"), status.alias("status"), (F.col("label_idx") != 1).alias("enabled"), (F.col("recording_id") % 31 != 5).alias("input_valid"), (F.col("recording_id") % 19).alias("valid_recordings"))


query(
    "analysis_status",
    lambda s, d: summaries.analysis_status(stage_rows(s, d)),
    f"""WITH {aq.SER_SQL}, k AS (SELECT DISTINCT recording_id AS e, label_idx AS l, recording_id*7 + label_idx*3 AS k FROM ser), t AS (SELECT e, CASE WHEN k % 53 = 0 THEN 'failed' WHEN k % 47 = 0 THEN 'blocked' WHEN k % 29 = 0 THEN 'insufficient_evidence' WHEN k % 11 = 0 THEN 'completed_with_reservations' ELSE 'completed' END AS s, l <> 1 AS en FROM k)
    SELECT e AS experiment_id, count(*) AS stages, CASE WHEN e % 31 = 5 THEN 'invalid_input' WHEN e % 19 = 0 THEN 'insufficient_evidence' WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'blocked') THEN 'partial' WHEN bool_or(s = 'insufficient_evidence' AND en) THEN 'partial' WHEN bool_or(s = 'completed_with_reservations') THEN 'completed_with_reservations' ELSE 'completed' END AS analysis_status FROM t GROUP BY 1""",
)

# ---- regimes ------------------------------------------------------------------------


def condition_summaries(s, d):
    """One row a condition, its evidence from the share of metrics it lacks and from its place."""
    m = cq.regime_metrics(s, d).groupBy("label_idx").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_fraction"))
    i = F.col("label_idx")
    return m.select(
        "label_idx", (i != 4).alias("valid"), (1 + i % 2).alias("valid_repeat_count"), F.when(i == 2, 0.25).alias("clipped_fraction"), F.when(i == 3, 0.5).otherwise(0.0).alias("near_clipped_fraction"),
        F.when(i != 1, 10.0 * i).alias("snr_db"), F.when(i != 0, 0.4 + 0.1 * i).alias("coverage"), (i == 1).alias("incomparable"), "missing_fraction", (i / 5).alias("max_variation"), (F.col("missing_fraction") > 0).alias("has_unavailable"),
    )


def limited(s, d):
    return regimes.limitations(condition_summaries(s, d), least_repeats=2, least_snr_db=5.0)


LIMIT_SQL = f"""{cq.REGIME_SQL}, mf AS (SELECT label_idx AS i, avg((value IS NULL)::INTEGER) AS mi FROM rm GROUP BY 1),
lm AS (SELECT i, mi, list_filter([CASE WHEN i = 4 THEN 'condition_summary_invalid' END, CASE WHEN 1 + i % 2 < 2 THEN 'insufficient_valid_repeats' END, CASE WHEN i = 2 THEN 'spectral_metrics_potentially_distorted_by_clipping' END, CASE WHEN i = 3 THEN 'spectral_metrics_potentially_affected_by_near_clipping' END,
  CASE WHEN i = 1 THEN 'signal_to_background_unavailable' END, CASE WHEN i <> 1 AND 10.0*i < 5 THEN 'low_signal_to_background_ratio' END, CASE WHEN i = 0 THEN 'temporal_coverage_unavailable' END, CASE WHEN i <> 0 AND 0.4 + 0.1*i < 0.5 THEN 'low_valid_temporal_coverage' END,
  CASE WHEN i = 1 THEN 'comparability_limitations_present' END, CASE WHEN mi > 0.5 THEN 'many_descriptor_metrics_unavailable' END, CASE WHEN i/5.0 > 0.5 THEN 'high_within_condition_variability' END], lambda x: x IS NOT NULL) AS l FROM mf)"""
query("regime_limitations", lambda s, d: limited(s, d).select("label_idx", F.concat_ws(",", "limitations").alias("limitations")), f"WITH {LIMIT_SQL} SELECT i AS label_idx, array_to_string(l, ',') AS limitations FROM lm")


def confident(s, d):
    c = cq.criteria(s, d)
    return regimes.confidence(limited(s, d), regimes.score(c), c)


CONFIDENCE_SQL = f"""{cq.LABEL_SQL}, {LIMIT_SQL[len(cq.REGIME_SQL) + 2:]}, bs AS (SELECT label_idx, max(f) AS best, sum(1 - f) AS cf FROM sl WHERE sel GROUP BY 1), gp AS (SELECT cr.label_idx, avg((NOT applicable)::INTEGER) AS gaps FROM cr JOIN sl ON sl.label_idx = cr.label_idx AND sl.descriptor = cr.descriptor AND sel GROUP BY 1),
cn AS (SELECT i AS label_idx, CASE WHEN i = 4 THEN 'insufficient' WHEN list_has_any(l, ['low_signal_to_background_ratio', 'signal_to_background_unavailable', 'low_valid_temporal_coverage', 'spectral_metrics_potentially_affected_by_near_clipping']) THEN 'low'
  WHEN best IS NULL THEN CASE WHEN mi > 0 THEN 'low' ELSE 'insufficient' END WHEN best >= 0.7 AND len(l) = 0 AND gaps <= 0.25 AND cf <= 0.25 THEN 'high'
  WHEN best >= 0.55 AND gaps <= 0.5 AND NOT list_has_any(l, ['spectral_metrics_potentially_distorted_by_clipping', 'spectral_metrics_potentially_affected_by_near_clipping', 'high_within_condition_variability', 'density_metrics_resolution_limited']) THEN 'moderate' ELSE 'low' END AS confidence FROM lm LEFT JOIN bs ON bs.label_idx = i LEFT JOIN gp ON gp.label_idx = i)"""
query("regime_confidence", confident, f"WITH {CONFIDENCE_SQL} SELECT * FROM cn")
query(
    "regime_patterns",
    lambda s, d: regimes.patterns(regimes.describe(regimes.score(cq.criteria(s, d))).join(confident(s, d), "label_idx")),
    f"""WITH {CONFIDENCE_SQL}, sh AS (SELECT label_idx, unnest([CASE WHEN structure = 'line_dominated' THEN 'tonal_structure_preserved_over_multiple_conditions' END, CASE WHEN structure IN ('dense', 'broadband') THEN 'increased_density_or_broadband_character_over_dynamic_order' END, CASE WHEN course = 'broadband_to_tonal' THEN 'broadband_attack_followed_by_more_tonal_tail' END,
      CASE WHEN confidence IN ('low', 'insufficient') THEN 'increased_uncertainty_or_limited_evidence' END]) AS pattern FROM de JOIN cn USING (label_idx))
    SELECT pattern, min(label_idx) AS start_idx, max(label_idx) AS end_idx, count(*) AS conditions FROM sh WHERE pattern IS NOT NULL GROUP BY 1 HAVING count(*) >= CASE WHEN pattern[1:5] IN ('tonal') OR pattern LIKE 'increased_density%' THEN 2 ELSE 1 END""",
)

# ---- scenarios ----------------------------------------------------------------------


query(
    "scenario_truth",
    lambda s, d: synthetic.truth(cq.part_components(s, d).select("scenario", "component_id", "f0", "amplitude", "tau_s", "detectable")),
    f"WITH {cq.PARTS_SQL} SELECT scenario, component_id, {r('f0', 'f0')}, {r('amplitude', 'amplitude')}, {r('tau_s', 'tau_s')}, detectable, {r('pi()*f0*tau_s', 'q')}, {r('1/(pi()*tau_s)', 'bandwidth_hz')} FROM cp",
)
query(
    "scenario_signals",
    lambda s, d: synthetic.summed(synthetic.component_waves(cq.part_components(s, d), 0.25, 64)),
    f"WITH {cq.PARTS_SQL}, {cq.waves_sql(0.25, 64)} SELECT scenario, n, {r('t', 't_s')}, {r('sum(round(env*turn, 12))', 'x')} FROM wv GROUP BY 1, 2, t",
)
query(
    "scenario_envelopes",
    lambda s, d: synthetic.component_waves(cq.part_components(s, d), 0.5, 16).select("scenario", "component_id", "n", "envelope"),
    f"WITH {cq.PARTS_SQL}, {cq.waves_sql(0.5, 16)} SELECT scenario, component_id, n, {r('env', 'envelope')} FROM wv",
)
query("candidate_recovery", lambda s, d: validation.candidate_recovery(cq.part_components(s, d), cq.part_candidates(s, d)))


def exchanging(s, d):
    """Found pairs of series, in fives, and which of them should exchange energy or should not."""
    a = mq.aligned(s, d)
    lags = mq.energy.best_negative(mq.energy.lag_correlations(a, mq.LAGS)).select(*mq.energy.PAIR, F.col("best_lag").cast("double").alias("best_lag_s"))
    found = mq.exchange(s, d).join(lags, mq.energy.PAIR, "left").withColumn("scenario", F.floor(F.col("source_a") / 5))
    both = F.col("source_a") + F.col("source_b")
    expected = found.filter(both % 3 == 0).select("scenario", "source_a", "source_b", (both % 5 - 2).cast("double").alias("lag_s"))
    return expected, found.filter(both % 3 == 1).select("scenario", "source_a", "source_b"), found.select("scenario", "source_a", "source_b", "status", "best_lag_s")


query(
    "exchange_recovery",
    lambda s, d: validation.exchange_recovery(*exchanging(s, d)),
    f"""WITH st AS ({ORACLE_SQL['energy_exchange']}), bl AS ({ORACLE_SQL['best_negative_lag']}),
    j AS (SELECT source_a // 5 AS scenario, (source_a + source_b) % 3 = 0 AS e, (source_a + source_b) % 3 = 1 AS n, status LIKE 'supported%' AS s, status = 'inconclusive' AS i, abs(best_lag - ((source_a + source_b) % 5 - 2))::DOUBLE AS le FROM st LEFT JOIN bl USING (source_a, source_b)),
    m AS (SELECT scenario, count(*) FILTER (WHERE e AND s) AS tp, count(*) FILTER (WHERE n AND s) AS fp, count(*) FILTER (WHERE e AND NOT s) AS fn, count(*) FILTER (WHERE s) AS su, count(*) FILTER (WHERE i) AS ic, max(le) FILTER (WHERE e AND s) AS le FROM j GROUP BY 1),
    q AS (SELECT *, CASE WHEN su > 0 THEN tp/su WHEN tp + fn = 0 THEN 1 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp/(tp + fn) ELSE 1 END::DOUBLE AS rc FROM m)
    SELECT scenario, tp AS true_positive, fp AS false_positive, fn AS false_negative, su AS supported, ic AS inconclusive, {r('le', 'lag_error_s')}, {r('p', 'precision')}, {r('rc', 'recall')}, {r('CASE WHEN p + rc > 0 THEN 2*p*rc/(p + rc) END', 'f1')}, fp = 0 AND fn = 0 AS passed FROM q""",
)
query(
    "scenario_status",
    lambda s, d: validation.scenario_status(QUERIES["bandwidth_errors"](s, d).select((F.col("candidate_id") % 41).alias("scenario"), "status")),
    f"""WITH c AS ({ORACLE_SQL['bandwidth_errors']}), g AS (SELECT candidate_id % 41 AS scenario, count(*) AS parts, count(*) FILTER (WHERE status = 'passed') AS p, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE status IN ('not_identifiable', 'resolution_limited')) AS l FROM c GROUP BY 1)
    SELECT scenario, parts, p AS passed_count, f AS failed_count, l AS limited_count, CASE WHEN f > 0 THEN 'failed' WHEN p = 0 THEN 'insufficient_evidence' WHEN l > 0 THEN 'passed_with_reservations' ELSE 'passed' END AS status FROM g""",
)
query(
    "trajectory_errors",
    lambda s, d: validation.trajectory_errors(
        points(s, d).select("recording_id", "track_id").distinct().select("recording_id", "track_id", (100.0 * (F.col("track_id") + 1)).alias("f0"), F.lit(0.25).alias("drift")), points(s, d).withColumn("t_s", F.col("t_s") / 86400), ["recording_id", "track_id"]
    ),
    f"""WITH {POINTS_SQL}, e AS (SELECT recording_id, track_id, t_s/86400 AS t, f, f - 100*(track_id + 1) - 0.25*t_s/86400 AS e FROM pt)
    SELECT recording_id, track_id, count(*) AS points, {r('avg(e)', 'mean_error_hz', 4)}, {r('sqrt(avg(e*e))', 'rms_error_hz', 4)}, {r('max(abs(e))', 'largest_error_hz', 4)}, {r('regr_slope(f, t) - 0.25', 'slope_error', 4)} FROM e GROUP BY 1, 2""",
    digits=4,
)

# ---- what figures show --------------------------------------------------------------

query(
    "view_global_spectrum",
    lambda s, d: views.global_spectrum(bins(s, d)).filter("f_hz > 0"),
    f"""WITH {BINS_SQL}, t AS (SELECT *, max(mag) OVER (PARTITION BY recording_id) AS top FROM bins) SELECT recording_id, {r('f_hz', 'f_hz', 5)}, {r('mag', 'mag', 5)}, {r('CASE WHEN mag > 0 THEN greatest(20*log10(mag/top), -120) ELSE -120 END', 'relative_db', 5)} FROM t WHERE k > 0""",
    digits=5,
)
query("view_spectral_peaks", lambda s, d: views.spectral_peaks(spectrum.peaks(bins(s, d))), f"WITH {PEAKS_SQL} SELECT recording_id, {r('coalesce(refined, f_hz)', 'f_hz')}, {r('mag', 'mag')}, {r('mag - prominence', 'base')} FROM peaks")
query("view_candidates", lambda s, d: views.candidates(candidate_refs(s, d)), f"WITH {REF_SQL} SELECT label_idx, recording_id, candidate_id, {r('frequency_hz', 'frequency_hz')}, {r('tau_s', 'tau_s')}, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS series FROM ref")
query("view_clusters", lambda s, d: views.cluster_members(QUERIES["condition_clusters"](s, d)))
query("view_parameters", lambda s, d: views.parameters(QUERIES["parameter_status"](s, d)), f"WITH c AS ({ORACLE_SQL['parameter_status']}) SELECT chain_id, frequency_hz, tau_s, parameter_status AS series FROM c")
query(
    "view_q_factors",
    lambda s, d: views.q_factors(QUERIES["q_combine"](s, d), "recording_id"),
    f"WITH c AS ({ORACLE_SQL['q_combine']}), e AS (SELECT recording_id, 'decay' AS method, q_decay AS q FROM c UNION ALL SELECT recording_id, 'bandwidth', q_bandwidth FROM c UNION ALL SELECT recording_id, 'representative', representative_q FROM c) SELECT * FROM e WHERE q IS NOT NULL",
)
query(
    "view_bandwidth",
    lambda s, d: views.bandwidth_lines(QUERIES["bandwidth_crossings"](s, d)),
    f"WITH c AS ({ORACLE_SQL['bandwidth_crossings']}), e AS (SELECT recording_id, target_hz, 'lower' AS line, low_hz AS f_hz FROM c UNION ALL SELECT recording_id, target_hz, 'peak', peak_hz FROM c UNION ALL SELECT recording_id, target_hz, 'upper', high_hz FROM c) SELECT * FROM e WHERE f_hz IS NOT NULL",
)
query(
    "view_exchange_evidence",
    lambda s, d: views.exchange_evidence(QUERIES["energy_exchange"](s, d)),
    f"WITH c AS ({ORACLE_SQL['energy_exchange']}) SELECT source_a, source_b, status, unnest(['opposed', 'negative', 'growth', 'recovery', 'possible_beating']) AS kind, unnest([opposed, negative, growth, recovery, possible_beating]) AS present FROM c",
)
query("view_validation", lambda s, d: views.true_and_estimated(QUERIES["frequency_errors"](s, d), ["candidate_id"]), f'WITH c AS ({ORACLE_SQL["frequency_errors"]}) SELECT candidate_id, "true", estimate, status FROM c')
query("view_campaign", lambda s, d: views.campaign(QUERIES["scenario_status"](s, d)), f"WITH c AS ({ORACLE_SQL['scenario_status']}) SELECT status, count(*) AS scenarios FROM c GROUP BY 1")
query(
    "view_trajectories",
    lambda s, d: views.trajectories(best_chains(s, d)),
    f"""WITH RECURSIVE {CHAINS_SQL}, ft AS (SELECT chain_id, regr_slope(frequency_hz, node_index) AS sl, regr_intercept(frequency_hz, node_index) AS ic FROM nodes GROUP BY 1)
    SELECT chain_id, label_idx, {r('frequency_hz', 'frequency_hz', 5)}, {r('ic + sl*node_index', 'fitted_hz', 5)} FROM nodes JOIN ft USING (chain_id)""",
    digits=5,
)


# ---- exported tables ----------------------------------------------------------------


def matches_view(s, d):
    m = aq.best(s, d)
    low, high = F.col("lower_hz"), F.col("higher_hz")
    return export.in_order(
        m.select(
            "*", label_of(F.col("pair")).alias("lower_dynamic_label"), label_of(F.col("pair") + 1).alias("higher_dynamic_label"), (high - low).alias("frequency_change_hz"), ((high - low) / (0.5 * (low + high))).alias("frequency_change_relative"),
            frequency_change(low, high, 0.05).alias("frequency_change_classification"), F.col("cost").alias("association_cost"),
        ),
        "cross_condition_matches",
    )


def _label(index: str) -> str:
    return cq.LABEL_CASE.replace("label_idx", index)


MATCH_COLUMNS = {c: c for c in ("lower_recording_id", "lower_candidate_id", "higher_recording_id", "higher_candidate_id")} | {
    "lower_dynamic_label": f"{_label('pair')} AS lower_dynamic_label", "higher_dynamic_label": f"{_label('(pair + 1)')} AS higher_dynamic_label", "association_cost": r("cost", "association_cost"),
    "frequency_change_hz": r("higher_hz - lower_hz", "frequency_change_hz"), "frequency_change_relative": r("(higher_hz - lower_hz)/(0.5*(lower_hz + higher_hz))", "frequency_change_relative"),
    "frequency_change_classification": "CASE WHEN abs(higher_hz - lower_hz) <= 0.05 + 1e-12 THEN 'preserved' WHEN higher_hz > lower_hz THEN 'shifted_up' ELSE 'shifted_down' END AS frequency_change_classification",
}
query("export_matches", matches_view, f"WITH {BEST_SQL} SELECT {cq.in_order_sql('cross_condition_matches', MATCH_COLUMNS)} FROM best")


def chains_view(s, d):
    c = association.chain_summary(best_chains(s, d), preserved_hz=0.05)
    return export.in_order(
        c.select(
            "chain_id", label_of(F.col("start_idx")).alias("start_dynamic_label"), label_of(F.col("end_idx")).alias("end_dynamic_label"), F.col("node_count").alias("condition_count"), (F.col("node_count") - 1).alias("match_count"),
            F.col("complete").alias("complete_across_requested_sequence"), (~F.col("complete") & ~F.col("isolated")).alias("partial_chain"), F.col("isolated").alias("isolated_candidate"), F.col("initial_hz").alias("initial_frequency_hz"),
            F.col("final_hz").alias("final_frequency_hz"), F.col("total_change_hz").alias("total_frequency_change_hz"), F.col("max_cost").alias("maximum_association_cost"),
        ),
        "candidate_chains",
    )


CHAIN_COLUMNS = {
    "chain_id": "chain_id", "start_dynamic_label": f"{_label('start_idx')} AS start_dynamic_label", "end_dynamic_label": f"{_label('end_idx')} AS end_dynamic_label", "condition_count": "node_count AS condition_count",
    "match_count": "node_count - 1 AS match_count", "complete_across_requested_sequence": "complete AS complete_across_requested_sequence", "partial_chain": "NOT complete AND NOT isolated AS partial_chain", "isolated_candidate": "isolated AS isolated_candidate",
    "initial_frequency_hz": "initial_hz AS initial_frequency_hz", "final_frequency_hz": "final_hz AS final_frequency_hz", "total_frequency_change_hz": "total_change_hz AS total_frequency_change_hz", "maximum_association_cost": "max_cost AS maximum_association_cost",
}
query("export_chains", chains_view, f"WITH c AS ({ORACLE_SQL['chains']}) SELECT {cq.in_order_sql('candidate_chains', CHAIN_COLUMNS)} FROM c")
