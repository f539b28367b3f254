"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to columns.

Fitting happens on the driver over a bounded, documented sample of labelled rows: shallow
boosted trees are grown over quantile cuts, every path of a tree becomes a conjunctive rule,
and a lasso logistic regression keeps few rules with weights.  Scoring is one Spark column
expression over statistics of the whole text: no Python runs on the rows, nothing is
shuffled, and every document is scored alone.

Defined results: a null text is an empty one, and empty texts have a score; labels other
than 0 and 1 (and null ones) teach nothing; repeated labelled rows count repeatedly up to
the sample's bound; without both classes the score is the smoothed share of label 1;
a text of any length is counted as a whole; an empty table gives no rows; other columns are
ignored, or stay as they are where rows are filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Labelled rows that a fit uses at most; of more, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000

#: Statistics of a text, as SQL over the columns that ``_prepared`` makes.
STATISTICS = {
    "chars": "double(n)",
    "words": "double(nw)",
    "word_length": "(n - n_space) / greatest(nw, 1)",
    "sign_share": "length(signs) / greatest(n, 1)",
    "signs_per_word": "length(signs) / greatest(nw, 1)",
    "bar_share": "length(regexp_replace(signs, '[^|]+', '')) / greatest(nw, 1)",
    "bang_share": "length(regexp_replace(signs, '[^!]+', '')) / greatest(nw, 1)",
    "upper_share": "length(uppers) / greatest(n, 1)",
    "upper_per_word": "length(uppers) / greatest(nw, 1)",
    "stop_share": "length(stops) / greatest(nw, 1)",
    "comma_share": "length(regexp_replace(stops, '[.]+', '')) / greatest(nw, 1)",
    "digit_share": "length(digits) / greatest(n, 1)",
    "distinct_words": "size(array_distinct(word_list)) / greatest(nw, 1)",
    "distinct_lines": "size(array_distinct(line_list)) / greatest(size(line_list), 1)",
    "line_words": "nw / greatest(size(line_list), 1)",
    "space_share": "n_space / greatest(n, 1)",
}
NAMES = tuple(STATISTICS)


def _prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with its text cut into words, lines and the characters of each class."""
    pieces = {
        "n": "length(body)",
        "word_list": "filter(split(body, '[ \\\\t-\\\\r]+'), w -> w != '')",
        "line_list": "filter(split(body, '\\n'), l -> l != '')",
        "n_space": "length(regexp_replace(body, '[^ \\\\t-\\\\r]+', ''))",
        "signs": "regexp_replace(body, '[^!#$%&*|~^<>{}]+', '')",
        "uppers": "regexp_replace(body, '[^\\\\p{Lu}]+', '')",
        "stops": "regexp_replace(body, '[^.,]+', '')",
        "digits": "regexp_replace(body, '[^0-9]+', '')",
    }
    return docs.selectExpr("*", *(f"{sql} AS {name}" for name, sql in pieces.items())).selectExpr("*", "size(word_list) AS nw")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep and every statistic of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty().alias("body"))
    return _prepared(rows).selectExpr("doc_id", *keep, *(f"double({sql}) AS {name}" for name, sql in STATISTICS.items()))


# ---- fitting ------------------------------------------------------------------------

Condition = tuple[int, float, bool]  # statistic's place, cut, whether it must be above


@dataclass(frozen=True)
class RuleModel:
    """logit = intercept + the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            out += weight * holds(x, conditions)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))

    def column(self) -> Column:
        """The score as an expression over columns named as in NAMES."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for place, cut, above in conditions:
                col = F.col(NAMES[place])
                test = test & ((col > F.lit(cut)) if above else (col <= F.lit(cut)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for place, cut, above in conditions:
        out &= (x[:, place] > cut) if above else (x[:, place] <= cut)
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths of one tree (all nodes but the root) and the tree's step for each row."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(grad))

    def node(rows: np.ndarray, path: tuple[Condition, ...], left: int) -> None:
        if path:
            paths.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                k = codes[rows, j]
                gs = np.cumsum(np.bincount(k, grad[rows], len(cut) + 1))[:-1]
                hs = np.cumsum(np.bincount(k, hess[rows], len(cut) + 1))[:-1]
                ns = np.cumsum(np.bincount(k, minlength=len(cut) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (j, at))
        if best[1] is None:
            step[rows] = g / (h + 1)
            return
        j, at = best[1]
        low = codes[rows, j] <= at
        node(rows[low], (*path, (j, float(cuts[j][at]), False)), left - 1)
        node(rows[~low], (*path, (j, float(cuts[j][at]), True)), left - 1)

    node(np.arange(len(grad)), (), depth)
    return paths, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss plus penalty times the weights' sum."""
    n, k = z.shape
    scale = 4.0 / max(np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n, 1e-9)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(vb + z @ vw, -30, 30))) - y
        nw = vw - scale * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - scale * penalty, 0)
        nb = vb - scale * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, cuts: int = 32, penalty: float = 0.002) -> RuleModel:
    """x: rows of statistics in the order of NAMES; y: labels 0 or 1."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        paths, step = _grow(codes, edges, y - p, p * (1 - p), depth, max(3, len(y) // 500))
        rules.update(dict.fromkeys(paths))
        logit += 0.3 * step
    listed = list(rules)
    if not listed:
        return RuleModel(float(logit[0]), ())
    z = np.stack([holds(x, r) for r in listed], 1).astype(float)
    same: dict[bytes, int] = {}
    for j in range(z.shape[1]):  # rules that hold for the same rows count once: the shortest
        key = z[:, j].tobytes()
        if key not in same or len(listed[j]) < len(listed[same[key]]):
            same[key] = j
    use = sorted(same.values())
    intercept, weights = _lasso(z[:, use], y, penalty)
    kept = [(listed[j], float(w)) for j, w in zip(use, weights, strict=True) if abs(w) > 1e-6]
    return RuleModel(intercept, tuple(kept))


def teaching(doc_id: Column) -> Column:
    """Whether a label may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents that may teach."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & teaching(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
    )
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # at most ``rows`` rows
    picked = few.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text")).limit(rows)
    values = statistics(picked, "y").toPandas()
    return values[list(NAMES)].to_numpy(float), values["y"].to_numpy(float)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> RuleModel:
    return fit_rules(*labelled_sample(docs, labels, label, rows))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``."""
    scored = statistics(docs).select("doc_id", model.column().alias("score"))
    return scored.select(
        "doc_id",
        (~F.coalesce(teaching(F.col("doc_id")), F.lit(True))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs`` that the model predicts as label 1, all columns as they were."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*own).alias("row"), text_or_empty().alias("body"))
    scored = _prepared(packed).selectExpr("row", *(f"double({sql}) AS {name}" for name, sql in STATISTICS.items()))
    return scored.filter(model.column() >= 0.5).select("row.*")
