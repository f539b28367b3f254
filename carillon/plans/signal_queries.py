"""Queries over signals: temporal, excitation, spectral and framed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectrum, stft, temporal
from ..sources.adapters import RATE, SER_SQL, SIG_SQL, recordings, series, signals
from .registry import query

WITH = f"WITH {SIG_SQL}, "


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL: a rounded double."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


# ---- temporal -----------------------------------------------------------------------

query(
    "recording_metrics",
    lambda s, d: temporal.recording_metrics(signals(s, d), clip_at=0.35),
    f"""WITH {SIG_SQL}, m AS (SELECT recording_id, max(abs(x)) p, sqrt(avg(x*x)) q, avg(x) dc, bool_or(abs(x) >= 0.35) c, count(*) n FROM sig GROUP BY 1)
    SELECT recording_id, {r('p', 'peak')}, {r('q', 'rms')}, {r('p/q', 'crest')}, {r('20*log10(p)', 'peak_dbfs')}, {r('20*log10(q)', 'rms_dbfs')}, {r('dc', 'dc_offset')}, c AS clipping, n AS n_samples FROM m""",
)

IMPACT_SQL = f"""{SIG_SQL}, amp AS (SELECT recording_id, n, abs(x) AS a FROM sig),
pk AS (SELECT recording_id, max(a) AS peak, arg_max(n, (a, -n)) AS peak_n, greatest(1, least(arg_max(n, (a, -n)), count(*) // 10)) AS base FROM amp GROUP BY 1),
b AS (SELECT amp.*, peak, peak_n, base FROM amp JOIN pk USING (recording_id)),
c AS (SELECT recording_id, median(a) AS centre FROM b WHERE n < base GROUP BY 1),
nz AS (SELECT recording_id, any_value(centre) + 8 * median(abs(a - centre)) AS noise FROM b JOIN c USING (recording_id) WHERE n < base GROUP BY 1),
hit AS (SELECT recording_id, peak, peak_n, greatest(0.05 * peak, noise) AS threshold, coalesce(min(n) FILTER (WHERE n <= peak_n AND a >= greatest(0.05 * peak, noise)), peak_n) AS impact_n
  FROM b JOIN nz USING (recording_id) GROUP BY recording_id, peak, peak_n, noise)"""

query(
    "impact",
    lambda s, d: temporal.impact(signals(s, d)),
    f"WITH {IMPACT_SQL} SELECT recording_id, {r('peak', 'peak')}, peak_n, {r('threshold', 'threshold')}, impact_n, {r('greatest(0, least(1, log10(peak/threshold)/2))', 'confidence')} FROM hit",
)
query(
    "transient_end",
    lambda s, d: temporal.transient_end(signals(s, d), temporal.impact(signals(s, d)), hold=3, fraction=0.6),
    f"""WITH {IMPACT_SQL}, w AS (SELECT recording_id, n, max(abs(x)) OVER o AS top, count(*) OVER o AS full_n FROM sig WINDOW o AS (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT recording_id, coalesce(min(n) FILTER (WHERE n > peak_n AND full_n = 3 AND top < greatest(0.6 * peak, threshold)), max(n)) AS transient_end_n FROM w JOIN hit USING (recording_id) GROUP BY 1""",
)
NOISE_SQL = f"""{SIG_SQL}, starts AS (SELECT recording_id, unnest(list_distinct(list_append(range(0, max(n) + 1 - 16 + 1, 8), max(n) + 1 - 16))) AS start_n FROM sig GROUP BY 1),
win AS (SELECT st.recording_id, start_n, sqrt(sum(x*x) / 16) AS rms FROM starts st JOIN sig ON sig.recording_id = st.recording_id AND n >= start_n AND n < start_n + 16 GROUP BY 1, 2),
nf AS (SELECT recording_id, start_n, rms AS noise_rms FROM win QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(rms, 12), start_n) = 1)"""
query("noise_window", lambda s, d: temporal.noise_floor(signals(s, d), 16), f"WITH {NOISE_SQL} SELECT recording_id, start_n, {r('noise_rms', 'noise_rms')} FROM nf")
query(
    "snr",
    lambda s, d: temporal.signal_to_noise(signals(s, d), 16),
    f"WITH {NOISE_SQL}, q AS (SELECT recording_id, sqrt(avg(x*x)) AS rms FROM sig GROUP BY 1) SELECT recording_id, {r('rms', 'rms')}, {r('noise_rms', 'noise_rms')}, {r('20*log10(rms/noise_rms)', 'snr_db')} FROM q JOIN nf USING (recording_id)",
)
query(
    "temporal_metrics",
    lambda s, d: temporal.temporal_metrics(signals(s, d), RATE),
    f"""WITH {SIG_SQL}, m AS (SELECT recording_id, max(abs(x)) p, sqrt(avg(x*x)) q, quantile_cont(abs(x), 0.05) FILTER (WHERE x <> 0) p5, quantile_cont(abs(x), 0.95) FILTER (WHERE x <> 0) p95, sum(x*x)/{RATE} e FROM sig GROUP BY 1)
    SELECT recording_id, {r('p', 'peak')}, {r('q', 'rms')}, {r('p/q', 'crest')}, {r('20*log10(p95/p5)', 'dynamic_range_db')}, {r('e', 'energy')} FROM m""",
)
query(
    "moving_rms",
    lambda s, d: temporal.moving_rms(signals(s, d), 7),
    f"WITH {SIG_SQL} SELECT recording_id, n, {r('sqrt(sum(x*x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7)', 'envelope')} FROM sig",
)
query(
    "moving_peak",
    lambda s, d: temporal.moving_peak(signals(s, d), 8),
    f"WITH {SIG_SQL} SELECT recording_id, n, {r('max(abs(x)) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)', 'envelope')} FROM sig",
)
query(
    "cumulative_energy",
    lambda s, d: temporal.cumulative_energy(signals(s, d), RATE),
    f"WITH {SIG_SQL} SELECT recording_id, n, {r(f'sum(x*x) OVER (PARTITION BY recording_id ORDER BY n) / {RATE}', 'energy')} FROM sig",
)
query(
    "series_metrics",
    lambda s, d: temporal.recording_metrics(series(s, d), clip_at=480.0),
    f"""WITH {SER_SQL}, m AS (SELECT recording_id, max(abs(x)) p, sqrt(avg(x*x)) q, avg(x) dc, bool_or(abs(x) >= 480) c, count(*) n FROM ser GROUP BY 1)
    SELECT recording_id, {r('p', 'peak', 8)}, {r('q', 'rms', 8)}, {r('p/q', 'crest', 8)}, {r('20*log10(p)', 'peak_dbfs', 8)}, {r('20*log10(q)', 'rms_dbfs', 8)}, {r('dc', 'dc_offset', 8)}, c AS clipping, n AS n_samples FROM m""",
    digits=8,
)
query(
    "interval",
    lambda s, d: temporal.interval(signals(s, d), 0.1, 0.5, RATE).groupBy("recording_id").agg(F.count("*").alias("n_samples"), F.sum("x").alias("total"), F.max("n").alias("last_n")),
    f"WITH {SIG_SQL} SELECT recording_id, count(*) AS n_samples, {r('sum(x)', 'total')}, max(n) - 7 AS last_n FROM sig WHERE n >= 7 AND n < 32 GROUP BY 1",
)
query(
    "mono_mean",
    lambda s, d: temporal.mono(signals(s, d).withColumn("channel", F.col("recording_id") % 2).withColumn("recording_id", F.floor(F.col("recording_id") / 2))),
    f"WITH {SIG_SQL} SELECT recording_id // 2 AS recording_id, n, {r('avg(x)', 'x')} FROM sig GROUP BY ALL",
)
query(
    "hilbert_envelope",
    lambda s, d: spectrum.hilbert_envelope(recordings(s, d)),
    # the transform of an even number of samples in the time domain: cotangents at odd distances
    f"""WITH {SIG_SQL}, h AS (SELECT p.recording_id, p.n, p.x, sum(CASE WHEN (p.n - q.n) % 2 <> 0 THEN q.x/tan(pi()*(p.n - q.n)/{RATE}) ELSE 0 END)*2/{RATE} AS y FROM sig p JOIN sig q ON q.recording_id = p.recording_id GROUP BY 1, 2, 3)
    SELECT recording_id, n, {r('sqrt(x*x + y*y)', 'envelope')} FROM h""",
)


def configured(s, d, method):
    return temporal.configured_envelope(recordings(s, d), method, window=9, rate=RATE)


query(
    "configured_envelope",
    lambda s, d: configured(s, d, "moving_rms").withColumn("method", F.lit("moving_rms")).unionByName(configured(s, d, "moving_peak").withColumn("method", F.lit("moving_peak"))),
    f"""WITH {SIG_SQL} SELECT recording_id, n, 'moving_rms' AS method, {r('sqrt(sum(x*x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)/9)', 'envelope')} FROM sig
    UNION ALL SELECT recording_id, n, 'moving_peak', {r('max(abs(x)) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)', 'envelope')} FROM sig""",
)
query(
    "clipping_run",
    lambda s, d: temporal.longest_run(signals(s, d).withColumn("loud", F.abs("x") >= 0.1), "loud"),
    f"""WITH {SIG_SQL}, f AS (SELECT recording_id, n, abs(x) >= 0.1 AS loud FROM sig), g AS (SELECT recording_id, n - row_number() OVER (PARTITION BY recording_id, loud ORDER BY n) AS run, loud FROM f),
    c AS (SELECT recording_id, count(*) AS c FROM g WHERE loud GROUP BY recording_id, run) SELECT i.recording_id, coalesce(max(c), 0) AS longest_run FROM (SELECT DISTINCT recording_id FROM sig) i LEFT JOIN c USING (recording_id) GROUP BY 1""",
)
query(
    "excitation_window",
    lambda s, d: temporal.excitation(signals(s, d), temporal.impact(signals(s, d)), RATE, clip=0.4, near=0.3),
    f"""WITH {IMPACT_SQL}, i AS (SELECT sig.*, abs(x) AS a, sum(x*x) OVER (PARTITION BY recording_id ORDER BY n) AS part, sum(x*x) OVER (PARTITION BY recording_id) AS total, max(abs(x)) OVER (PARTITION BY recording_id) AS top
      FROM sig JOIN hit USING (recording_id) WHERE t_s - impact_n / {RATE}.0 >= -0.01 - 1e-12 AND t_s - impact_n / {RATE}.0 <= 0.20 + 1e-12),
    m AS (SELECT recording_id, max(a) pa, max(x) pp, min(x) pn, avg(x) dc, sqrt(avg(x*x)) q, sum(x*x)/{RATE} e, min(t_s) FILTER (WHERE part >= 0.05*total) t5, min(t_s) FILTER (WHERE part >= 0.95*total) t95,
      min(t_s) FILTER (WHERE a >= 0.1*top) tr, min(t_s) FILTER (WHERE a = top) tp, count(*) FILTER (WHERE a >= 0.4) c, count(*) FILTER (WHERE a >= 0.3) nc, count(*) n FROM i GROUP BY 1)
    SELECT recording_id, {r('pa', 'peak_absolute')}, {r('pp', 'peak_positive')}, {r('pn', 'peak_negative')}, {r('(pp - abs(pn))/pa', 'asymmetry')}, {r('dc', 'dc_offset')}, {r('q', 'rms')}, {r('e', 'energy')},
      {r('20*log10(q)', 'level_dbfs')}, {r('pa/q', 'crest')}, {r('t95-t5', 'impulse_duration_s')}, {r('tp-tr', 'attack_s')}, c AS clipped, nc AS near_clipped, n AS n_samples FROM m""",
)
query(
    "dynamic_order",
    lambda s, d: temporal.dynamic_order(signals(s, d).groupBy("label_idx").agg(F.max(F.abs("x")).alias("value"))),
    f"""WITH {SIG_SQL}, v AS (SELECT label_idx, max(abs(x)) AS value FROM sig GROUP BY 1), w AS (SELECT *, lead(label_idx) OVER (ORDER BY label_idx) AS next_idx, lead(value) OVER (ORDER BY label_idx) - value AS ch FROM v)
    SELECT label_idx, next_idx, {r('ch', 'change')}, CASE WHEN abs(ch) <= 1e-9 THEN 'tie' WHEN ch > 0 THEN 'ordered' ELSE 'inversion' END AS relation FROM w WHERE next_idx IS NOT NULL""",
)

# ---- spectra ------------------------------------------------------------------------

N = RATE


def bins(s, d):
    return spectrum.spectrum_bins(recordings(s, d), RATE)


BINS_SQL = f"""{SIG_SQL}, cen AS (SELECT recording_id, n, (x - avg(x) OVER (PARTITION BY recording_id)) * (0.5 - 0.5 * cos(2 * pi() * n / {N - 1})) AS y FROM sig),
dft AS (SELECT recording_id, k, sqrt(pow(sum(y * cos(2 * pi() * k * n / {N})), 2) + pow(sum(y * sin(2 * pi() * k * n / {N})), 2)) AS m FROM cen, range(0, {N // 2 + 1}) AS t(k) GROUP BY 1, 2),
bins AS (SELECT recording_id, k, k::DOUBLE AS f_hz, m / ({N} * (SELECT avg(0.5 - 0.5 * cos(2 * pi() * i / {N - 1})) FROM range(0, {N}) AS u(i))) * CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END AS mag FROM dft)"""
query("spectrum_bins", bins, f"WITH {BINS_SQL} SELECT recording_id, k, {r('f_hz', 'f_hz')}, {r('mag', 'mag')} FROM bins")
query(
    "dominant_bin",
    lambda s, d: spectrum.dominant_bin(bins(s, d)),
    f"WITH {BINS_SQL} SELECT recording_id, k, {r('f_hz', 'f_hz')}, {r('mag', 'mag')} FROM bins QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(mag, 9) DESC, k) = 1",
)
query(
    "spectrum_dbfs",
    lambda s, d: spectrum.spectrum_levels(bins(s, d).filter("k > 0")),
    f"WITH {BINS_SQL} SELECT recording_id, k, {r('f_hz', 'f_hz')}, {r('CASE WHEN mag > 0 THEN 20*log10(mag) END', 'level_dbfs')} FROM bins WHERE k > 0",
)
PEAKS_SQL = f"""{BINS_SQL}, nb AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS h FROM bins WINDOW w AS (PARTITION BY recording_id ORDER BY k)), pk AS (SELECT * FROM nb WHERE mag > l AND mag > h),
side AS (SELECT p.recording_id, p.k, max(b.k) FILTER (WHERE b.k < p.k AND b.mag > p.mag) AS lk, min(b.k) FILTER (WHERE b.k > p.k AND b.mag > p.mag) AS rk FROM pk p JOIN bins b USING (recording_id) GROUP BY 1, 2),
prom AS (SELECT p.recording_id, p.k, any_value(p.mag) - greatest(min(b.mag) FILTER (WHERE b.k <= p.k AND b.k > coalesce(lk, -1)), min(b.mag) FILTER (WHERE b.k >= p.k AND b.k < coalesce(rk, 1000))) AS prominence,
  median(b.mag) FILTER (WHERE abs(b.k - p.k) BETWEEN 2 AND 10) AS noise FROM pk p JOIN side s USING (recording_id, k) JOIN bins b ON b.recording_id = p.recording_id GROUP BY 1, 2),
peaks AS (SELECT pk.recording_id, pk.k, pk.f_hz, pk.mag, prominence, noise, CASE WHEN abs(0.5*(ln(l)-ln(h))/(ln(l)-2*ln(mag)+ln(h))) <= 1 THEN f_hz + 0.5*(ln(l)-ln(h))/(ln(l)-2*ln(mag)+ln(h)) END AS refined FROM pk JOIN prom USING (recording_id, k))"""
PEAK_COLUMNS = f"recording_id, k, {r('f_hz', 'f_hz')}, {r('mag', 'mag')}, {r('prominence', 'prominence')}, {r('refined', 'refined_hz')}, {r('noise', 'noise_floor')}, {r('20*log10(mag/noise)', 'snr_db')}"
query("spectral_peaks", lambda s, d: spectrum.peaks(bins(s, d)).drop("width_bins"), f"WITH {PEAKS_SQL} SELECT {PEAK_COLUMNS} FROM peaks")
query("spectral_peaks_top", lambda s, d: spectrum.peaks(bins(s, d), keep=3).drop("width_bins"), f"WITH {PEAKS_SQL} SELECT {PEAK_COLUMNS} FROM peaks QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY round(mag, 9) DESC, k) <= 3")
query("spectral_peaks_prominent", lambda s, d: spectrum.peaks(bins(s, d), height=0.01, prominence=0.02).drop("width_bins"), f"WITH {PEAKS_SQL} SELECT {PEAK_COLUMNS} FROM peaks WHERE mag >= 0.01 AND prominence >= 0.02")
query("spectral_peaks_spaced", lambda s, d: spectrum.peaks(bins(s, d), distance=4))


def power(s, d):
    return spectrum.powers(bins(s, d))


POWER_SQL = f"{BINS_SQL}, pw AS (SELECT recording_id, k, f_hz, mag*mag AS p FROM bins)"
query(
    "spectral_moments",
    lambda s, d: spectrum.moments(power(s, d)),
    f"""WITH {POWER_SQL}, a AS (SELECT recording_id, sum(p) AS tot, sum(p*f_hz)/sum(p) AS c FROM pw GROUP BY 1),
    m AS (SELECT recording_id, tot, c, sum(p*pow(f_hz-c,2))/tot v, sum(p*pow(f_hz-c,3))/tot m3, sum(p*pow(f_hz-c,4))/tot m4, exp(avg(ln(p)) FILTER (WHERE p > 0)) ge, avg(p) FILTER (WHERE p > 0) ar,
      -sum(p/tot*ln(p/tot)) FILTER (WHERE p > 0) h, count(*) FILTER (WHERE p > 0) np, max(p) top, avg(p) mp FROM pw JOIN a USING (recording_id) GROUP BY recording_id, tot, c)
    SELECT recording_id, {r('tot', 'total')}, {r('c', 'centroid')}, {r('sqrt(v)', 'spread')}, {r('m3/pow(v,1.5)', 'skewness')}, {r('m4/(v*v)', 'kurtosis')}, {r('ge/ar', 'flatness')}, {r('h/ln(np)', 'entropy')}, {r('top/mp', 'crest')} FROM m""",
    digits=6,
)
query(
    "rolloff",
    lambda s, d: spectrum.rolloffs(power(s, d)),
    f"""WITH {POWER_SQL}, c AS (SELECT recording_id, f_hz, sum(p) OVER (PARTITION BY recording_id ORDER BY k) AS part, sum(p) OVER (PARTITION BY recording_id) AS tot FROM pw)
    SELECT recording_id, {', '.join(f'min(f_hz) FILTER (WHERE part >= {x}*tot - 1e-12) AS rolloff_{round(100 * x)}' for x in spectrum.ROLLOFFS)} FROM c GROUP BY 1""",
)
BANDS = [("low", 0.0, 8.0), ("middle", 8.0, 20.0), ("high", 20.0, 33.0)]
query(
    "band_energy",
    lambda s, d: spectrum.band_energy(power(s, d), BANDS),
    f"""WITH {POWER_SQL}, b(band, lo, hi) AS (VALUES ('low', 0, 8), ('middle', 8, 20), ('high', 20, 33)), t AS (SELECT recording_id, sum(p) AS tot FROM pw GROUP BY 1)
    SELECT recording_id, band, {r('sum(p)', 'energy')}, {r('sum(p)/any_value(tot)', 'energy_fraction')} FROM pw JOIN t USING (recording_id) JOIN b ON f_hz >= lo AND f_hz < hi GROUP BY 1, 2""",
)
query(
    "tonal_residual",
    lambda s, d: spectrum.tonal_residual(power(s, d), spectrum.peaks(bins(s, d), prominence=0.02), 1.0),
    f"""WITH {PEAKS_SQL}, pw AS (SELECT recording_id, k, f_hz, mag*mag AS p FROM bins), t AS (SELECT pw.*, EXISTS (SELECT 1 FROM peaks q WHERE q.recording_id = pw.recording_id AND q.prominence >= 0.02 AND abs(q.f_hz - pw.f_hz) <= 1) AS tonal FROM pw),
    m AS (SELECT recording_id, coalesce(sum(p) FILTER (WHERE tonal), 0) AS a, sum(p) AS b FROM t GROUP BY 1) SELECT recording_id, {r('a', 'tonal')}, {r('b-a', 'residual')}, {r('a/b', 'tonal_fraction')} FROM m""",
)
query(
    "occupied_band",
    lambda s, d: spectrum.occupied_band(power(s, d), 0.1),
    f"""WITH {POWER_SQL}, m AS (SELECT recording_id, f_hz, p >= 0.1 * max(p) OVER (PARTITION BY recording_id) AS i FROM pw), g AS (SELECT recording_id, min(f_hz) FILTER (WHERE i) lo, max(f_hz) FILTER (WHERE i) hi, avg(i::INTEGER) o FROM m GROUP BY 1)
    SELECT recording_id, {r('lo', 'low_hz')}, {r('hi', 'high_hz')}, {r('o', 'occupied_fraction')}, {r('hi-lo', 'bandwidth_hz')} FROM g""",
)
query(
    "peak_spacing",
    lambda s, d: spectrum.peak_spacing(spectrum.peaks(bins(s, d))),
    f"""WITH {PEAKS_SQL}, g AS (SELECT recording_id, f_hz, f_hz - lag(f_hz) OVER (PARTITION BY recording_id ORDER BY f_hz) AS gap FROM peaks),
    m AS (SELECT recording_id, count(*) c, median(gap) md, avg(gap) av, min(gap) mi, max(f_hz) - min(f_hz) sp FROM g GROUP BY 1)
    SELECT recording_id, c AS peak_count, {r('md', 'median_spacing_hz')}, {r('av', 'mean_spacing_hz')}, {r('mi', 'min_spacing_hz')}, {r('sp', 'span_hz')}, {r('c/nullif(sp, 0)', 'density_per_hz')} FROM m""",
)
query(
    "peak_isolation",
    lambda s, d: spectrum.peak_isolation(spectrum.peaks(bins(s, d)), 3.0),
    f"""WITH {PEAKS_SQL}, g AS (SELECT recording_id, k, f_hz, f_hz - lag(f_hz) OVER w AS lo, lead(f_hz) OVER w - f_hz AS hi FROM peaks WINDOW w AS (PARTITION BY recording_id ORDER BY f_hz)), o AS (SELECT *, coalesce(greatest(0, least(1, (3 - least(lo, hi))/3)), 0) AS ov FROM g)
    SELECT recording_id, k, {r('f_hz', 'f_hz')}, {r('lo', 'below_hz')}, {r('hi', 'above_hz')}, {r('least(lo, hi)', 'nearest_hz')}, {r('ov', 'overlap')}, ov = 0 AS isolated FROM o""",
)


def _settings(s, d, step: int):
    """A description of each recording's analysis that differs between two runs in known places."""
    e = F.col("recording_id")
    return recordings(s, d).select(e, F.lit(RATE).alias("sample_rate_hz"), F.when(e % (3 + step) == 0, "hann").otherwise("rectangular").alias("window"), F.when(e % (4 + step) != 0, e % 2).alias("channel"))


query(
    "comparability",
    lambda s, d: spectrum.mismatches(_settings(s, d, 0), _settings(s, d, 1), ["recording_id"], ["sample_rate_hz", "window", "channel"]).withColumn("mismatches", F.concat_ws(",", "mismatches")),
    """WITH c AS (SELECT vec_id AS recording_id, CASE WHEN vec_id % 3 = 0 THEN 'hann' ELSE 'rectangular' END a, CASE WHEN vec_id % 4 = 0 THEN 'hann' ELSE 'rectangular' END b,
      CASE WHEN vec_id % 4 <> 0 THEN vec_id % 2 END p, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 2 END q FROM embeddings), m AS (SELECT recording_id, concat_ws(',', CASE WHEN a <> b THEN 'window' END, CASE WHEN p IS DISTINCT FROM q THEN 'channel' END) AS mismatches FROM c)
    SELECT recording_id, mismatches, mismatches = '' AS comparable FROM m""",
)

# ---- frames -------------------------------------------------------------------------

L, HOP = 16, 8


def frames(s, d):
    return stft.stft_bins(recordings(s, d), RATE, L, HOP)


FRAMES_SQL = f"""{SIG_SQL}, fr AS (SELECT recording_id, f AS frame, n - f * {HOP} AS j, x - avg(x) OVER (PARTITION BY recording_id, f) AS y FROM sig JOIN range(0, {(N - L) // HOP + 1}) AS t(f) ON n >= f * {HOP} AND n < f * {HOP} + {L}),
fd AS (SELECT recording_id, frame, k, sqrt(pow(sum(y * (0.5 - 0.5*cos(2*pi()*j/{L - 1})) * cos(2*pi()*k*j/{L})), 2) + pow(sum(y * (0.5 - 0.5*cos(2*pi()*j/{L - 1})) * sin(2*pi()*k*j/{L})), 2)) AS m FROM fr, range(0, {L // 2 + 1}) AS u(k) GROUP BY 1, 2, 3),
fb AS (SELECT recording_id, frame, (frame * {HOP} + {(L - 1) / 2}) / {RATE} AS t_s, k, k * {RATE} / {L}.0 AS f_hz, m / ({L} * (SELECT avg(0.5 - 0.5*cos(2*pi()*i/{L - 1})) FROM range(0, {L}) AS v(i))) * CASE WHEN k IN (0, {L // 2}) THEN 1 ELSE 2 END AS mag FROM fd)"""
query("stft_bins", frames, f"WITH {FRAMES_SQL} SELECT recording_id, frame, {r('t_s', 't_s')}, k, {r('f_hz', 'f_hz')}, {r('mag', 'mag')} FROM fb")
query(
    "frame_stats",
    lambda s, d: stft.frame_stats(frames(s, d), 0.05),
    f"WITH {FRAMES_SQL} SELECT recording_id, frame, {r('t_s', 't_s')}, {r('max(mag)', 'top')}, {r('median(mag)', 'floor')}, max(mag) <= 0.05 AS silent FROM fb GROUP BY recording_id, frame, fb.t_s",
)
query(
    "frame_peaks",
    lambda s, d: stft.frame_peaks(frames(s, d), 0.02),
    f"""WITH {FRAMES_SQL}, nb AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS h FROM fb WINDOW w AS (PARTITION BY recording_id, frame ORDER BY k)), p AS (SELECT * FROM nb WHERE mag > l AND mag > h AND mag >= 0.02)
    SELECT recording_id, frame, {r('t_s', 't_s')}, row_number() OVER (PARTITION BY recording_id, frame ORDER BY k) - 1 AS peak, k, {r('f_hz', 'f_hz')}, {r('mag', 'mag')}, {r(f'f_hz + 0.5*(ln(l)-ln(h))/(ln(l)-2*ln(mag)+ln(h)) * {RATE / L}', 'refined_hz')} FROM p""",
)
FDESC_SQL = f"""{FRAMES_SQL}, fp AS (SELECT *, mag*mag AS p FROM fb), fe AS (SELECT recording_id, frame, t_s, sum(p) e, sum(p*f_hz)/sum(p) c, exp(avg(ln(p)))/avg(p) fl, arg_max(f_hz, (round(p, 12), -k)) dom FROM fp GROUP BY ALL),
fx AS (SELECT fe.*, sqrt(sum(p*pow(f_hz-c,2))/e) sp, -sum(p/e*ln(p/e))/ln(count(*)) en FROM fe JOIN fp USING (recording_id, frame, t_s) GROUP BY recording_id, frame, t_s, e, c, fl, dom),
ml AS (SELECT recording_id, frame, t_s, unnest(['energy', 'centroid_hz', 'spread_hz', 'flatness', 'entropy']) AS metric, unnest([e, c, sp, fl, en]) AS value FROM fx)"""
query(
    "frame_descriptors",
    lambda s, d: stft.frame_descriptors(frames(s, d)),
    f"WITH {FDESC_SQL} SELECT recording_id, frame, {r('t_s', 't_s')}, true AS valid, {r('e', 'energy')}, {r('c', 'centroid_hz')}, {r('sp', 'spread_hz')}, {r('fl', 'flatness')}, {r('en', 'entropy')}, {r('dom', 'dominant_hz')} FROM fx",
    digits=6,
)


def desc(s, d):
    return stft.frame_descriptors(frames(s, d))


query(
    "frame_summary",
    lambda s, d: stft.summary(desc(s, d)),
    f"WITH {FDESC_SQL} SELECT recording_id, metric, {r('arg_min(value, frame)', 'first')}, {r('arg_max(value, frame)', 'last')}, {r('min(value)', 'least')}, {r('max(value)', 'largest')}, count(*) AS valid_frames FROM ml GROUP BY 1, 2",
)
query(
    "frame_regions",
    lambda s, d: stft.regions(desc(s, d), [("early", 0.0, 0.3), ("middle", 0.3, 0.6), ("late", 0.6, 0.9)]),
    f"""WITH {FDESC_SQL}, w(region, lo, hi) AS (VALUES ('early', 0.0, 0.3), ('middle', 0.3, 0.6), ('late', 0.6, 0.9))
    SELECT recording_id, metric, region, {r('median(value) FILTER (WHERE t_s >= lo AND t_s < hi)', 'median')}, count(*) FILTER (WHERE t_s >= lo AND t_s < hi) AS frames FROM ml, w GROUP BY 1, 2, 3""",
)
query(
    "frame_trends",
    lambda s, d: stft.trends(desc(s, d)),
    f"""WITH {FDESC_SQL}, t AS (SELECT recording_id, metric, count(*) n, regr_slope(value, t_s) sl, regr_intercept(value, t_s) ic, regr_syy(value, t_s) yy, regr_sxx(value, t_s) xx, regr_sxy(value, t_s) xy FROM ml GROUP BY 1, 2)
    SELECT recording_id, metric, n, {r('sl', 'slope', 5)}, {r('ic', 'intercept', 5)}, {r('1 - greatest(0, yy - xy*xy/xx)/yy', 'r_squared', 5)}, {r('sqrt(greatest(0, yy - xy*xy/xx)/n)', 'rmse', 5)} FROM t""",
    digits=5,
)


def series_metric(s, d):
    return series(s, d).select("recording_id", F.lit("value").alias("metric"), "n", "t_s", F.col("x").alias("value"))


CHANGE_SQL = f"""WITH {SER_SQL}, v AS (SELECT * FROM ser), w AS (SELECT recording_id, n, t_s, avg(x) OVER b AS mb, avg(x) OVER a AS ma, count(*) OVER b AS cb, count(*) OVER a AS ca FROM v
  WINDOW b AS (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY recording_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
h AS (SELECT *, abs(ma - mb) >= 100 AS hit FROM w WHERE cb = 2 AND ca = 2), g AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n) - row_number() OVER (PARTITION BY recording_id, hit ORDER BY n) AS run FROM h)
SELECT recording_id, 'value' AS metric, min(n) AS at, {r('arg_min(t_s, n)', 't_s')}, {r('arg_min(ma - mb, n)', 'change')}, count(*) AS places FROM g WHERE hit GROUP BY recording_id, run HAVING count(*) >= 2"""
query("change_points", lambda s, d: stft.change_points(series_metric(s, d), threshold=100.0), CHANGE_SQL.replace(" AS at,", ' AS "at",'))
query(
    "smooth",
    lambda s, d: stft.smooth(series_metric(s, d), 2),
    f"WITH {SER_SQL} SELECT recording_id, 'value' AS metric, n, {r('t_s', 't_s')}, {r('avg(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'value')} FROM ser",
)
query(
    "smooth_median",
    lambda s, d: stft.smooth(series_metric(s, d), 2, "median", chunk=16),
    f"WITH {SER_SQL} SELECT recording_id, 'value' AS metric, n, {r('t_s', 't_s')}, {r('median(x) OVER (PARTITION BY recording_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'value')} FROM ser",
)


# ---- frames relative to an impact ----------------------------------------------------

BEFORE, AFTER = -0.125, 0.7


def struck(s, d):
    """Each recording's highest sample as its impact, moved before the begin or behind the end of some."""
    from pyspark.sql import Window

    w = Window.partitionBy("recording_id").orderBy(F.desc(F.abs("x")), "n")
    top = signals(s, d).withColumn("place", F.row_number().over(w)).filter("place = 1")
    moved = F.when(F.col("recording_id") % 9 == 0, F.col("t_s") - 3).when(F.col("recording_id") % 9 == 1, F.col("t_s") + 3).otherwise(F.col("t_s"))
    return top.select("recording_id", moved.alias("hit_s"))


def impact_layout(s, d):
    return stft.frame_layout(recordings(s, d), struck(s, d), RATE, L, HOP, BEFORE, AFTER, pad_end=False)


LAYOUT_SQL = f"""{SIG_SQL}, tp AS (SELECT recording_id, t_s FROM sig QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY abs(x) DESC, n) = 1),
ht AS (SELECT recording_id, t_s + CASE recording_id % 9 WHEN 0 THEN -3 WHEN 1 THEN 3 ELSE 0 END AS hit_s FROM tp), sz AS (SELECT recording_id, count(*) AS size, count(*)/{RATE}.0::DOUBLE AS dur FROM sig GROUP BY 1),
rq AS (SELECT *, hit_s + {BEFORE}::DOUBLE AS a, hit_s + {AFTER}::DOUBLE AS b FROM ht JOIN sz USING (recording_id)), rr AS (SELECT *, b <= 0 OR a >= dur OR least(dur, b) <= greatest(0, a) AS outside FROM rq),
lo AS (SELECT *, CASE WHEN NOT outside THEN ceil(greatest(0, a)*{RATE} - 1e-9)::BIGINT END AS begin_, CASE WHEN NOT outside THEN floor(least(dur, b)*{RATE} + 1e-9)::BIGINT END AS stop_ FROM rr),
ly AS (SELECT *, coalesce(CASE WHEN stop_ - begin_ >= {L} THEN (stop_ - begin_ - {L}) // {HOP} + 1 END, 0) AS frames FROM lo)"""
query(
    "impact_frame_layout",
    impact_layout,
    f"""WITH {LAYOUT_SQL}, nt AS (SELECT *, stop_ - (begin_ + frames*{HOP}) AS rest FROM ly)
    SELECT recording_id, {r('hit_s', 'hit_s')}, begin_ AS "begin", stop_ AS stop, frames, FALSE AS padded, CASE WHEN outside THEN 'analysis_window_outside_signal' ELSE concat_ws(',', CASE WHEN a < 0 THEN 'analysis_start_clipped_to_signal' END, CASE WHEN b > dur THEN 'analysis_end_clipped_to_signal' END,
      CASE WHEN rest > 0 THEN 'final_incomplete_frame_discarded_samples=' || rest END, CASE WHEN frames = 0 THEN 'segment_shorter_than_frame_duration' END) END AS notes FROM nt""",
)
query(
    "impact_frames",
    lambda s, d: stft.impact_frames(recordings(s, d), impact_layout(s, d), RATE, L, HOP, minimum_energy=0.002),
    f"""WITH {LAYOUT_SQL}, st AS (SELECT recording_id, hit_s, f AS frame, begin_ + f*{HOP} AS start_n FROM ly, range(0, {N}) AS t(f) WHERE f < frames),
    fr AS (SELECT recording_id, hit_s, frame, start_n, n - start_n AS j, x - avg(x) OVER (PARTITION BY recording_id, frame) AS y FROM st JOIN sig USING (recording_id) WHERE n >= start_n AND n < start_n + {L}),
    fd AS (SELECT recording_id, hit_s, frame, start_n, k, sqrt(pow(sum(y*(0.5 - 0.5*cos(2*pi()*j/{L - 1}))*cos(2*pi()*k*j/{L})), 2) + pow(sum(y*(0.5 - 0.5*cos(2*pi()*j/{L - 1}))*sin(2*pi()*k*j/{L})), 2)) AS m FROM fr, range(0, {L // 2 + 1}) AS u(k) GROUP BY ALL),
    fb AS (SELECT *, k*{RATE}/{L}.0 AS f_hz, m/({L}*(SELECT avg(0.5 - 0.5*cos(2*pi()*i/{L - 1})) FROM range(0, {L}) AS v(i)))*CASE WHEN k IN (0, {L // 2}) THEN 1 ELSE 2 END AS mag FROM fd),
    nb AS (SELECT *, mag*mag AS p, lag(mag) OVER w AS l, lead(mag) OVER w AS h FROM fb WINDOW w AS (PARTITION BY recording_id, frame ORDER BY k)),
    ag AS (SELECT recording_id, hit_s, frame, start_n, sum(p) AS e, sum(p*f_hz)/sum(p) AS c, arg_max(f_hz, (round(p, 12), -k)) AS dom, arg_max(f_hz, p) FILTER (WHERE mag > l AND mag > h) AS pk, max(p) FILTER (WHERE mag > l AND mag > h) AS pp FROM nb GROUP BY ALL), vd AS (SELECT *, e >= 0.002 AS v FROM ag)
    SELECT recording_id, frame, {r(f'start_n/{RATE}.0', 'start_s')}, {r(f'(start_n + {L / 2})/{RATE}.0', 'center_s')}, {r(f'(start_n + {L / 2})/{RATE}.0 - hit_s', 'relative_s')}, FALSE AS padded, v AS valid, CASE WHEN NOT v THEN 'frame_energy_below_threshold' END AS reason, {r('e', 'energy')},
      {r('CASE WHEN v THEN c END', 'centroid_hz')}, {r('CASE WHEN v THEN dom END', 'dominant_hz')}, {r('CASE WHEN v THEN pk END', 'strongest_peak_hz')}, {r('CASE WHEN v THEN pp/e END', 'strongest_share')}, CASE WHEN v THEN coalesce(pk = dom, FALSE) END AS peak_is_dominant FROM vd""",
)
