"""Command line: analyze, export, report, validate-synthetic, inspect, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import VERSION

#: Exit codes by status.
EXIT = {"completed": 0, "completed_with_reservations": 1, "invalid_configuration": 2, "missing_input": 3, "failed": 4}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="carillon", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "analyse WAV files and print counts"), ("export", "write result tables"), ("report", "write a report")):
        c = sub.add_parser(name, help=text)
        c.add_argument("recordings", nargs="+", help="LABEL=PATH or LABEL:TAKE=PATH")
        c.add_argument("--config", help="TOML or JSON file; its pipeline section overrides defaults")
        c.add_argument("--channel", type=int, default=0)
        c.add_argument("--folder", help="keeps shared tables for later runs")
        if name == "export":
            c.add_argument("--out", required=True)
            c.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
            c.add_argument("--overwrite", choices=("error", "skip", "replace", "versioned"), default="error", help="what happens where an export is there already")
        if name == "report":
            c.add_argument("--out", required=True)
            c.add_argument("--format", choices=("markdown", "latex"), default="markdown")
    sub.add_parser("validate-synthetic", help="recover known decay times and frequencies")
    i = sub.add_parser("inspect", help="list the stages")
    i.add_argument("--json", action="store_true")
    sub.add_parser("version")
    return p


def _analysis(spark, args):
    from pyspark.sql import functions as F

    from .plans.experiment import Settings, analyze
    from .sources import experiment, wav
    from .sources.adapters import LABELS

    config = experiment.load_configuration(args.config).get("pipeline", {}) if args.config else {}
    specs = [experiment.recording_spec(s) for s in args.recordings]
    for _, _, path in specs:
        if not Path(path).exists():
            raise FileNotFoundError(path)
    frames = []
    for k, (label, take, path) in enumerate(specs):
        one = wav.select_and_trim(wav.read_wav(spark, path, glob="*"), args.channel).filter("failure IS NULL")
        frames.append(one.select(F.lit(k).cast("long").alias("recording_id"), F.lit(LABELS.index(label)).alias("label_idx"), F.lit(take).alias("take"), "sample_rate_hz", "samples"))
    recs = frames[0]
    for f in frames[1:]:
        recs = recs.unionByName(f)
    rates = [r[0] for r in recs.select("sample_rate_hz").distinct().collect()]  # as many as files at most
    if not rates:
        raise ValueError("no recording could be decoded")
    if len(rates) > 1:
        raise ValueError(f"recordings of different sample rates: {sorted(rates)}")
    return analyze(recs, Settings(**({"rate": rates[0]} | config)), args.folder)


def validate(spark) -> list[dict]:
    """Decay time and frequency of ideal decaying sines from generated samples."""
    from pyspark.sql import functions as F

    from .operators import stft, tracking
    from .sources import synthetic

    out = []
    for f0, tau in ((500.0, 2.0), (220.0, 0.8)):
        sig = synthetic.damped_sum(spark, [(f0, 1 / tau, 1.0, 0.0)], 2.0, 4096)
        rec = sig.groupBy(F.lit(0).cast("long").alias("recording_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s.x).alias("samples"))
        points = tracking.track_peaks(stft.frame_peaks(stft.stft_bins(rec, 4096, 512, 128), 0.05).withColumn("f_hz", F.coalesce("refined_hz", "f_hz")))
        fit = tracking.amplitude_fit(points).join(tracking.track_features(points).select(*tracking.BY, "frequency_median", "amplitude_max"), tracking.BY).orderBy(F.desc("amplitude_max")).first()
        ok = fit is not None and abs(fit.frequency_median - f0) <= 2 and abs(fit.tau_s / tau - 1) <= 0.35
        out.append({"f0": f0, "tau_s": tau, "frequency_hz": fit and fit.frequency_median, "tau_found_s": fit and fit.tau_s, "status": "passed" if ok else "failed"})
    return out


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "inspect":
        from .plans.experiment import STAGES

        print(json.dumps(STAGES) if args.json else "\n".join(f"{s}: {', '.join(n) or '-'}" for s, n in STAGES.items()))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("carillon").getOrCreate()
    try:
        if args.command == "validate-synthetic":
            found = validate(spark)
            print(json.dumps(found))
            return EXIT["completed"] if all(f["status"] == "passed" for f in found) else EXIT["failed"]
        analysis = _analysis(spark, args)
        if args.command == "analyze":
            print(json.dumps({r.stage: r.row_count for r in analysis.summary().collect()}))
        elif args.command == "export":
            from .operators.publish import publish

            stages = ("peaks", "candidates", "chains", "hypotheses", "parameters", "quality_factors", "comparison", "regimes")
            key = ("recording_id", "candidate_id")
            keys = {"chains": [(key, "candidates", key)], "hypotheses": [(("chain_id",), "chains", ("chain_id",))]}
            version = publish({s: analysis.table(s) for s in stages}, args.out, args.overwrite, args.format, analysis.identity(), keys)
            print(json.dumps({"version": version}))
        else:
            from . import report

            Path(args.out).write_text((report.markdown if args.format == "markdown" else report.latex)(analysis))
        return EXIT["completed"]
    except FileNotFoundError as e:
        print(f"missing input: {e}", file=sys.stderr)
        return EXIT["missing_input"]
    except (ValueError, TypeError) as e:
        print(f"invalid configuration: {e}", file=sys.stderr)
        return EXIT["invalid_configuration"]


if __name__ == "__main__":
    sys.exit(run())
