"""Votes over candidate pools. Every vote is two aggregations with map-side combining: by (id, answer), then by id.

An equal top goes to the answer whose first occurrence is earliest; a null answer counts in denominators and never wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least common multiple of 1..32: shares of arms of up to 32 votes are whole numbers of it.
SHARE_UNIT = 144403552893600
CLIP = 1e-6
#: Weights are compared after rounding, as engines sum floating point in different orders.
DIGITS = 9


def majority(pool: DataFrame) -> DataFrame:
    """id, answer, valid, total, agreement, tie, top, second, vote_counts."""
    by_answer = pool.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("sample_index").alias("first"))
    valid = F.col("answer").isNotNull()
    out = by_answer.groupBy("id").agg(
        F.max_by("answer", F.when(valid, F.struct("n", -F.col("first")))).alias("answer"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid"),
        F.sum("n").alias("total"),
        F.sort_array(F.collect_list(F.when(valid, F.col("n"))), asc=False).alias("_n"),
        F.array_join(F.sort_array(F.collect_list(F.when(valid, F.concat_ws(":", "answer", "n")))), ",").alias("vote_counts"),
    )
    top, second = F.coalesce(F.get("_n", F.lit(0)), F.lit(0).cast("long")), F.coalesce(F.get("_n", F.lit(1)), F.lit(0).cast("long"))
    return out.select("id", "answer", "valid", "total", (top / F.col("total")).alias("agreement"), ((top > 0) & (top == second)).alias("tie"), top.alias("top"), second.alias("second"), "vote_counts")


def filtered_majority(pool: DataFrame, reasons: Column) -> DataFrame:
    """Majority of the votes without reasons against them; where that has none, the unfiltered majority."""
    kept = F.when(F.size(reasons) == 0, F.col("answer"))
    marked = pool.withColumn("_kept", kept)
    by_answer = marked.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("sample_index").alias("first"), F.count("_kept").alias("m"), F.min(F.when(F.col("_kept").isNotNull(), F.col("sample_index"))).alias("mfirst"))
    return by_answer.groupBy("id").agg(
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct("n", -F.col("first")))).alias("_all"),
        F.max_by("answer", F.when(F.col("m") > 0, F.struct("m", -F.col("mfirst")))).alias("_kept"),
    ).select("id", F.coalesce("_kept", "_all").alias("answer"), (F.col("_kept").isNull() & F.col("_all").isNotNull()).alias("fallback"))


@dataclass(frozen=True)
class Policy:
    """Factors of a candidate's weight, in millionths so that sums are exact."""

    name: str
    paths: tuple[tuple[str, int], ...]
    hit_max: int = 1_000_000
    conflict: int = 0
    full_tokens: int | None = None
    completion: tuple[int, int, int] | None = None

    def weight(self) -> Column:
        """In 10**-18 units as decimal(38,0): path x conflict x (completion or hit-max) x length."""
        unit = lambda n: F.lit(n).cast("decimal(8,0)")
        path = unit(0)
        for name, value in self.paths:
            path = F.when(F.col("path") == name, unit(value)).otherwise(path)
        weight = path * F.when(F.col("conflict"), unit(self.conflict)).otherwise(unit(1_000_000))
        if self.completion:
            cut, marked, plain = map(unit, self.completion)
            weight = weight * F.when(F.col("hit_max"), cut).when(F.col("marked_last"), marked).otherwise(plain)
        else:
            weight = weight * F.when(F.col("hit_max"), unit(self.hit_max)).otherwise(unit(1_000_000))
        if self.full_tokens:
            weight = weight * F.least(F.col("tokens"), F.lit(self.full_tokens)).cast("decimal(8,0)")
        return F.when(F.col("answer").isNull(), F.lit(0)).otherwise(weight).cast("decimal(38,0)")


# The frozen weights of extraction paths and corrections.
_CONTINUOUS = (("final_answer_marker", 1_000_000), ("boxed", 700_000), ("last_integer", 150_000), ("standalone_last_line", 100_000))
POLICIES = (
    Policy("path_binary", (("final_answer_marker", 1_000_000), ("boxed", 1_000_000)), hit_max=0),
    Policy("path_continuous", _CONTINUOUS, hit_max=50_000),
    Policy("path_plus_length", _CONTINUOUS, hit_max=50_000, full_tokens=100),
    Policy("path_plus_completion", _CONTINUOUS, completion=(50_000, 1_000_000, 800_000)),
)


def weighted_majority(pool: DataFrame, weight: Column) -> DataFrame:
    """The largest exact weight sum; ties to the first positive-weight occurrence; nothing positive: raw majority."""
    rows = pool.withColumn("_w", weight)
    positive = F.col("_w") > 0
    by_answer = rows.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("sample_index").alias("first"), F.sum(F.when(positive, F.col("_w"))).alias("w"), F.min(F.when(positive, F.col("sample_index"))).alias("wfirst"))
    best = by_answer.groupBy("id").agg(
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct("n", -F.col("first")))).alias("_raw"),
        F.max_by("answer", F.when(F.col("w") > 0, F.struct("w", -F.col("wfirst")))).alias("_won"),
        F.max("w").alias("_top"),
        F.sum("w").alias("_total"),
    )
    return best.select("id", F.coalesce("_won", "_raw").alias("answer"), F.col("_won").isNull().alias("fallback"), F.coalesce(F.col("_top").cast("double") / F.col("_total").cast("double"), F.lit(0.0)).alias("weighted_agreement"))


def geometric_vote(pool: DataFrame) -> DataFrame:
    """n * exp(mean(ln(clipped score))) an answer; a score that isn't finite anywhere in a question: raw majority."""
    score = F.col("score").cast("double")
    odd = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    clipped = F.greatest(F.least(score, F.lit(1 - CLIP)), F.lit(CLIP))
    by_answer = pool.groupBy("id", "answer").agg(F.count("*").alias("n"), F.min("sample_index").alias("first"), F.count_if(odd).alias("odd"), F.avg(F.ln(clipped)).alias("mean"))
    weight = F.round(F.col("n") * F.exp("mean"), DIGITS)
    valid = F.col("answer").isNotNull()
    out = by_answer.groupBy("id").agg(
        F.sum("odd").alias("_odd"),
        F.max_by("answer", F.when(valid, F.struct("n", -F.col("first")))).alias("_raw"),
        F.max_by("answer", F.when(valid, F.struct(weight.alias("w"), -F.col("first")))).alias("_won"),
        F.max(F.when(valid, weight)).alias("weight"),
    )
    return out.select("id", F.when(F.col("_odd") > 0, F.col("_raw")).otherwise(F.col("_won")).alias("answer"), (F.col("_odd") > 0).alias("fallback"), "weight")


def best_scored(pool: DataFrame) -> DataFrame:
    """The answer of the best-scored candidate, invalid ones included, so it may be null."""
    return pool.groupBy("id").agg(F.max_by(F.struct("answer"), F.struct("score", -F.col("sample_index"))).alias("b")).select("id", F.col("b.answer").alias("answer"))


def positions(pool: DataFrame, width: int) -> DataFrame:
    """Places of candidates when arms follow one another, `width` places an arm."""
    return pool.withColumn("position", F.col("arm") * width + F.col("sample_index"))


def flat_vote(pool: DataFrame, width: int = 32) -> DataFrame:
    """Majority over the arms' candidates one after another."""
    return majority(positions(pool, width).withColumn("sample_index", F.col("position"))).select("id", "answer", "tie", "valid")


def arm_normalised_vote(pool: DataFrame, width: int = 32) -> DataFrame:
    """Sum of each arm's answer shares in exact whole units; ties to the first place. An arm of more valid votes than the
    unit has divisors for (32) is an error rather than an inexact share."""
    counts = positions(pool, width).where("answer is not null").groupBy("id", "arm", "answer").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    valid = counts.groupBy("id", "arm").agg(F.sum("n").alias("valid"))
    shares = counts.join(valid, ["id", "arm"]).groupBy("id", "answer").agg(F.sum(F.expr(f"if(valid > 32, raise_error('an arm has more than 32 valid votes'), n * ({SHARE_UNIT}L div valid))")).alias("units"), F.min("first").alias("first"))
    won = shares.groupBy("id").agg(F.max_by("answer", F.struct("units", -F.col("first"))).alias("answer"), F.max("units").alias("units"))
    return pool.select("id").distinct().join(won, "id", "left")


def answer_groups(pool: DataFrame) -> DataFrame:
    """Features of each answer group: support, traces, score statistics, first index, margin, invalid and hit-max rates."""
    groups = pool.where("answer is not null").groupBy("id", "answer").agg(
        F.count("*").alias("support"),
        F.count_distinct("trace").alias("unique_traces"),
        F.avg("score").alias("mean_score"),
        F.percentile("score", F.lit(0.5)).alias("median_score"),
        F.min("score").alias("min_score"),
        F.stddev_pop("score").alias("std_score"),
        F.var_pop("score").alias("var_score"),
        F.min("sample_index").alias("first_index"),
        F.avg(F.col("hit_max").cast("int")).alias("hit_max_rate"),
    )
    votes = majority(pool).select("id", (F.col("top") - F.col("second")).alias("margin"), ((F.col("total") - F.col("valid")) / F.col("total")).alias("invalid_rate"))
    return groups.join(votes, "id")


def override(inputs: DataFrame, m_max: float, n_min: float, g_min: float, r_max: float) -> DataFrame:
    """Five conditions, all needed to replace the raw answer by the alternative; failed ones are named in order."""
    conditions = {
        "orm_differs_from_raw": ~F.col("raw_answer").eqNullSafe(F.col("orm_answer")),
        "raw_top2_margin_at_most_m_max": F.col("margin") <= m_max,
        "orm_alternative_support_at_least_n_min": F.col("support_share") >= n_min,
        "group_score_gap_at_least_g_min": F.col("gap") >= g_min,
        "raw_top_vote_share_at_most_r_max": F.col("top_share") <= r_max,
    }
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in conditions.items())))
    out = inputs.withColumn("_failed", failed)
    passed = F.size("_failed") == 0
    return out.select("id", "raw_answer", "orm_answer", F.when(passed, F.col("orm_answer")).otherwise(F.col("raw_answer")).alias("final_answer"), passed.alias("overridden"), F.when(passed, F.lit("all_conditions_passed")).otherwise(F.concat(F.lit("preserve_raw:"), F.array_join("_failed", ","))).alias("reason"))


def two_stage_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("id", F.col("answer").alias("_a")).join(second.select("id", F.col("answer").alias("_b")), "id", "full_outer").select("id", F.coalesce("_a", "_b").alias("answer"), F.when(F.col("_a").isNotNull(), 1).when(F.col("_b").isNotNull(), 2).alias("stage"))
