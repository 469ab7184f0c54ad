"""Evaluation statistics: accuracy, pass and agreement, paired tests, ranking and calibration measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segment_accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    """Correct, total and accuracy a segment; predictions have `correct`."""
    return predictions.groupBy(*by).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def question_outcomes(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question: greedy, any correct (pass), the number of correct candidates, and of all."""
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    return pool.join(gold, "id").groupBy("id").agg(F.max(F.when(F.col("sample_index") == 0, hit)).alias("greedy"), F.max(hit).alias("passed"), F.count_if(hit).alias("c"), F.count("*").alias("k"))


def _ranges(rows: DataFrame, score: str, cuts: int = 256) -> DataFrame:
    """rows with _range, the number of cut points below the score: equal scores share one, and all hold alike many rows."""
    points = rows.agg(F.percentile_approx(score, F.array(*(F.lit(i / cuts) for i in range(1, cuts))), 10_000).alias("_cuts"))
    return rows.crossJoin(F.broadcast(points)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts")


def auc(rows: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """ROC-AUC by average ranks; null where a class is absent.

    Ranks are taken over distinct scores with their counts. Over the whole table they are taken within ranges of the score
    and moved by what lies below the range, so no task orders all scores.
    """
    ties = rows.groupBy(*by, score).agg(F.sum(F.col(label)).alias("_p"), F.count("*").alias("_n"))
    if by:
        within, ties = [*by], ties.withColumn("_offset", F.lit(0).cast("long"))
    else:
        within, ties = ["_range"], _ranges(ties, score)
        lower = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        offsets = ties.groupBy("_range").agg(F.sum("_n").alias("_size")).withColumn("_offset", F.coalesce(F.sum("_size").over(lower), F.lit(0))).drop("_size")
        ties = ties.join(offsets, "_range")
    before = W.partitionBy(*within).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranked = ties.withColumn("_below", F.col("_offset") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = ranked.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_below") + (F.col("_n") + 1) / 2)).alias("_r"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return sums.select(*by, F.when((F.col("_p") > 0) & (neg > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)).alias("auc"))


def average_precision(rows: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """Mean precision at the positives by falling score, ties in order of a key; ranked within ranges of the score."""
    ranged = _ranges(rows.select(F.col(label).alias("_y"), F.col(score).alias("_s"), F.col(tie).alias("_t")), "_s")
    higher = W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum("_y").alias("_py"), F.count("*").alias("_pn"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_py").over(higher), F.lit(0)).alias("_oy"), F.coalesce(F.sum("_pn").over(higher), F.lit(0)).alias("_on"))
    w = W.partitionBy("_range").orderBy(F.desc("_s"), "_t").rowsBetween(W.unboundedPreceding, 0)
    running = ranged.join(offsets, "_range").select("_y", ((F.col("_oy") + F.sum("_y").over(w)) / (F.col("_on") + F.count("*").over(w))).alias("_precision"))
    return running.agg(F.try_divide(F.sum(F.when(F.col("_y") == 1, F.col("_precision"))), F.sum("_y")).alias("average_precision"))


def brier(rows: DataFrame, label: str, p: str) -> DataFrame:
    return rows.agg(F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"))


def ece(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    binned = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(label).alias("y"), F.avg(p).alias("p"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def numeric_smd(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Standardised mean difference; with no variance at all 0, or infinite where the means differ."""
    s = rows.agg(F.avg(F.when(F.col(label) == 1, F.col(value))).alias("a"), F.avg(F.when(F.col(label) == 0, F.col(value))).alias("b"), F.var_pop(F.when(F.col(label) == 1, F.col(value))).alias("va"), F.var_pop(F.when(F.col(label) == 0, F.col(value))).alias("vb"))
    d, v = F.col("a") - F.col("b"), (F.col("va") + F.col("vb")) / 2
    return s.select(F.when(v > 0, d / F.sqrt(F.when(v > 0, v))).when(d == 0, F.lit(0.0)).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))).alias("smd"))


def categorical_smd(rows: DataFrame, label: str, category: str) -> DataFrame:
    """Per category, the standardised difference of its shares in the two classes."""
    totals = rows.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    shares = rows.groupBy(category).agg(F.count_if(F.col(label) == 1).alias("c1"), F.count_if(F.col(label) == 0).alias("c0")).crossJoin(F.broadcast(totals))
    p, q = F.try_divide("c1", "n1"), F.try_divide("c0", "n0")
    v = (p * (1 - p) + q * (1 - q)) / 2
    return shares.select(category, F.when(v > 0, (p - q) / F.sqrt(F.when(v > 0, v))).when(p == q, 0.0).when(p > q, float("inf")).otherwise(float("-inf")).alias("smd"))


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation near the mean."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term, k = term * v * v, k + 2
        more = total + term / k
        if more == total:
            return total
        total = more


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided binomial tail of the smaller of two discordant counts, of any size: the middle term by its saddle
    point, the others from it by their ratios until they no longer count."""
    n, low = only_a + only_b, min(only_a, only_b)
    if n == 0 or 2 * low == n:
        return 1.0
    if low == 0:
        return min(1.0, 2 * 0.5**n) if n < 1075 else 0.0
    log = _stirling_rest(n) - _stirling_rest(low) - _stirling_rest(n - low) - _deviance(low, n / 2) - _deviance(n - low, n / 2)
    term = math.exp(log) * math.sqrt(n / (2 * math.pi * low * (n - low)))
    total, i = 0.0, low
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Exact two-sided McNemar test of paired correctness columns: only_a, only_b, n, difference and p_value.

    The counts are one aggregation; the tail of two numbers is computed on the driver."""
    r = pairs.agg(F.count_if(F.col(a) & ~F.col(b)), F.count_if(F.col(b) & ~F.col(a)), F.count("*")).first()
    difference = f"{(r[0] - r[1]) / r[2]!r}D" if r[2] else "CAST(NULL AS DOUBLE)"
    return pairs.sparkSession.sql(f"SELECT {r[0]}L AS only_a, {r[1]}L AS only_b, {r[2]}L AS n, {difference} AS difference, {mcnemar_p(r[0], r[1])!r}D AS p_value")


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = successes / total
    centre, spread = p + z * z / (2 * total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    scale = 1 + z * z / total
    return (centre - spread) / scale, (centre + spread) / scale


def paired_bootstrap(pairs: DataFrame, a: str, b: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile interval of the accuracy difference.

    A pair is one of three outcomes, so the resampled difference depends on the three counts alone: they are drawn as
    multinomials on the driver, whatever the table's size, and the draw is the same on every run.
    """
    import numpy as np

    r = pairs.agg(F.count_if(F.col(a) & ~F.col(b)), F.count_if(F.col(b) & ~F.col(a)), F.count("*")).first()
    n = max(int(r[2]), 1)
    draws = np.random.default_rng(seed).multinomial(n, [r[0] / n, r[1] / n, max(0.0, 1 - (r[0] + r[1]) / n)], size=rounds)
    diff = (draws[:, 0] - draws[:, 1]) / n
    low, high = np.quantile(diff, [0.025, 0.975])
    return pairs.sparkSession.sql(f"SELECT {(r[0] - r[1]) / n}D AS difference, {float(low)}D AS low, {float(high)}D AS high")
