"""A linear selector over answer-group features, fitted by projected gradient descent on group cross-entropy, out of fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("support", "mean_score", "std_score")
#: Questions a fold's weights are fitted on, at most, in hash order.
FIT_QUESTIONS = 5_000


def fit(questions: list[list[tuple[tuple[float, ...], bool]]], steps: int = 200, rate: float = 0.1) -> tuple[float, ...]:
    """Weights that raise the softmax share of right groups; support and mean score count up, deviation counts down."""
    w = np.zeros(len(FEATURES))
    sign = np.array([1.0, 1.0, -1.0])
    usable = [(np.array([f for f, _ in q]), np.array([y for _, y in q], float)) for q in questions if any(y for _, y in q) and len(q) > 1]
    for _ in range(steps if usable else 0):
        g = np.zeros(len(w))
        for x, y in usable:
            s = np.exp(x @ w - (x @ w).max())
            s /= s.sum()
            t = s * y
            g += x.T @ (t / t.sum() - s)
        w = w + rate * g / len(usable)
        w = np.where(w * sign < 0, 0, w)
    return tuple(float(round(v, 9)) for v in w)


def cross_fitted_choice(groups: DataFrame, gold: DataFrame, folds: int = 2, fit_questions: int = FIT_QUESTIONS) -> DataFrame:
    """(id, fold, answer): each fold's questions are decided with weights fitted on a bounded sample of the others.

    Ties go to the earliest group. Scoring is a built-in expression over all groups.
    """
    rows = groups.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int"))
    score = None
    for fold in range(folds):
        sample = rows.where(F.col("fold") != fold).select("id").distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(fit_questions)
        marked = rows.join(F.broadcast(sample), "id").join(gold.select("id", "gold"), "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first_index", *FEATURES, (F.col("answer") == F.col("gold")).alias("y")))).alias("g"))
        weights = fit([[(tuple(float(c[f]) for f in FEATURES), bool(c["y"])) for c in r["g"]] for r in marked.orderBy("id").collect()])
        linear = sum((F.col(f) * w for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0))
        score = F.when(F.col("fold") == fold, linear) if score is None else score.when(F.col("fold") == fold, linear)
    scored = rows.withColumn("_s", F.round(score, 9))
    return scored.groupBy("id", "fold").agg(F.max_by("answer", F.struct("_s", -F.col("first_index"))).alias("answer"))
