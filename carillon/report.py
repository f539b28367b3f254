"""Reports of an analysis as Markdown or LaTeX, and a check of what they claim."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import export
from .plans.experiment import Analysis

#: Claims that no report may make.
FORBIDDEN = (
    "confirmed physical mode",
    "confirmed energy transfer",
    "proven nonlinear behavior",
    "causality demonstrated",
    "physical split",
    "physical merge",
    "modo fisico confirmado",
    "transferencia de energia confirmada",
    "comportamento nao linear comprovado",
    "causalidade demonstrada",
    "split fisico",
    "merge fisico",
)
SECTIONS = ("summary", "stages", "excitation", "descriptors", "candidates", "within_condition", "cross_condition", "chains", "comparison", "regimes", "hypotheses", "parameters", "quality_factors")


def sections(analysis: Analysis) -> dict[str, DataFrame]:
    named: dict[str, Callable[[], DataFrame]] = {"summary": analysis.summary, "stages": analysis.stages}
    return {s: named[s]() if s in named else analysis.table(s) for s in SECTIONS}


def markdown(analysis: Analysis, title: str = "Analysis", rows: int = 20) -> str:
    parts = [f"# {title}", f"Settings fingerprint: `{analysis.settings.fingerprint()}`"]
    parts += [f"## {name.replace('_', ' ').capitalize()}\n\n{export.to_markdown(df, rows)}" for name, df in sections(analysis).items()]
    return "\n\n".join(parts) + "\n\nHypotheses are statements about the data at hand and not about the instrument.\n"


def latex(analysis: Analysis, title: str = "Analysis", rows: int = 20) -> str:
    parts = [r"\documentclass{article}", r"\usepackage{booktabs}", r"\begin{document}", rf"\section*{{{title}}}"]
    parts += [rf"\subsection*{{{name.replace('_', ' ')}}}" + "\n" + export.to_latex(df, rows) for name, df in sections(analysis).items()]
    return "\n".join([*parts, r"\end{document}"]) + "\n"


def problems(text: str) -> list[str]:
    """Forbidden claims in a report."""
    low = text.lower()
    return [f"forbidden claim: {w}" for w in FORBIDDEN if w in low]


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(analysis: Analysis, files: dict[str, str]) -> dict:
    """What a report was made from and the checksum of each of its files (name → content)."""
    return {
        **analysis.identity(),
        "sections": list(SECTIONS),
        "files": {name: {"sha256": checksum(text), "characters": len(text)} for name, text in sorted(files.items())},
        "problems": {name: problems(text) for name, text in sorted(files.items())},
    }


def summary(made: dict) -> dict:
    """Counts of a manifest."""
    found = sum(map(len, made["problems"].values()))
    return {"section_count": len(made["sections"]), "file_count": len(made["files"]), "problem_count": found, "valid": found == 0}


def settings_fingerprint(title: str, rows: int) -> str:
    return export.fingerprint({"title": title, "rows": rows, "sections": list(SECTIONS)})
