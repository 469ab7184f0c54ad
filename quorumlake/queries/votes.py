"""Votes, evaluation and statistics over the candidate pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlake.operators import metrics, voting
from quorumlake.operators.pool import coverage, low_quality_reasons, prefix, scored, splice, unanimous, union_pools
from quorumlake.queries.registry import GROUPS, MAJORITY, POOL, VOTES, Tables, query

_CONFLICT = "trace % 11 = 0"
_REASONS = f"list_filter([CASE WHEN path IN ('standalone_last_line', 'last_integer') THEN 'weak_extraction_path' END, CASE WHEN hit_max THEN 'hit_max_new_tokens' END, CASE WHEN {_CONFLICT} THEN 'conflicting_explicit_candidates' END], lambda x: x IS NOT NULL)"


def _reasons():
    return low_quality_reasons(F.col("path"), F.col("hit_max"), F.expr(_CONFLICT))


def _judged(t: Tables, votes: DataFrame) -> DataFrame:
    return votes.join(t.gold, "id").withColumn("correct", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)))


@query(f"{VOTES} SELECT segment, count(*) FILTER (WHERE answer = gold) AS correct, count(*) AS total, round(avg(CASE WHEN answer = gold THEN 1 ELSE 0 END), 9) AS accuracy, round(avg(top / total), 9) AS agreement FROM maj JOIN gold USING (id) GROUP BY segment")
def flagship_majority_accuracy(t: Tables) -> DataFrame:
    judged = _judged(t, voting.majority(t.pool))
    return judged.groupBy("segment").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.round(F.avg("agreement"), 9).alias("agreement"))


@query(f"{VOTES} SELECT id, answer, valid, total, round(top / total, 9) AS agreement, top > 0 AND top = second AS tie, top, second, coalesce((SELECT string_agg(answer || ':' || n, ',' ORDER BY answer || ':' || n) FROM g WHERE g.id = maj.id AND g.answer IS NOT NULL), '') AS vote_counts FROM maj")
def a2_majority_vote(t: Tables) -> DataFrame:
    return voting.majority(t.pool).withColumn("agreement", F.round("agreement", 9))


@query(f"WITH {POOL} SELECT id, sample_index, array_to_string({_REASONS}, ',') AS reasons FROM pool")
def p3_vote_filter_reasons(t: Tables) -> DataFrame:
    return t.pool.select("id", "sample_index", F.array_join(_reasons(), ",").alias("reasons"))


@query(f"""WITH {POOL}, k AS (SELECT *, CASE WHEN len({_REASONS}) = 0 THEN answer END AS kept FROM pool),
 a AS (SELECT id, answer, count(*) AS n, min(sample_index) AS f, count(kept) AS m, min(sample_index) FILTER (WHERE kept IS NOT NULL) AS mf FROM k WHERE answer IS NOT NULL GROUP BY 1, 2),
 v AS (SELECT id, first(answer ORDER BY n DESC, f) AS al, first(answer ORDER BY m DESC, mf) FILTER (WHERE m > 0) AS ke FROM a GROUP BY id)
 SELECT p.id, coalesce(ke, al) AS answer, ke IS NULL AND al IS NOT NULL AS fallback FROM (SELECT DISTINCT id FROM pool) p LEFT JOIN v USING (id)""")
def a3_filtered_majority(t: Tables) -> DataFrame:
    return voting.filtered_majority(t.pool, _reasons())


def _weights_sql(policy: voting.Policy) -> str:
    path = "CASE path " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in policy.paths) + " ELSE 0 END"
    factors = [f"{path}::HUGEINT", f"CASE WHEN {_CONFLICT} THEN {policy.conflict} ELSE 1000000 END"]
    factors.append("CASE WHEN hit_max THEN {} WHEN trace % 3 = 0 THEN {} ELSE {} END".format(*policy.completion) if policy.completion else f"CASE WHEN hit_max THEN {policy.hit_max} ELSE 1000000 END")
    if policy.full_tokens:
        factors.append(f"least(tokens, {policy.full_tokens})")
    return "CASE WHEN answer IS NULL THEN 0 ELSE " + " * ".join(factors) + " END"


def _weighted_sql(policy: voting.Policy) -> str:
    return f"""SELECT '{policy.name}' AS policy, id, coalesce(won, raw) AS answer, won IS NULL AS fallback, round(coalesce(top / tot, 0), 9) AS weighted_agreement FROM (
      SELECT id, first(answer ORDER BY n DESC, f) FILTER (WHERE answer IS NOT NULL) AS raw, first(answer ORDER BY w DESC, wf) FILTER (WHERE w > 0) AS won, max(w)::DOUBLE AS top, sum(w)::DOUBLE AS tot FROM (
        SELECT id, answer, count(*) AS n, min(sample_index) AS f, sum(w) FILTER (WHERE w > 0) AS w, min(sample_index) FILTER (WHERE w > 0) AS wf FROM (SELECT *, {_weights_sql(policy)} AS w FROM pool) GROUP BY 1, 2) GROUP BY id)"""


@query(f"WITH {POOL} " + " UNION ALL ".join(_weighted_sql(p) for p in voting.POLICIES))
def a4_weighted_majority(t: Tables) -> DataFrame:
    rows = t.pool.withColumns({"conflict": F.expr(_CONFLICT), "marked_last": F.col("trace") % 3 == 0})
    out = None
    for p in voting.POLICIES:
        one = voting.weighted_majority(rows, p.weight()).select(F.lit(p.name).alias("policy"), "id", "answer", "fallback", F.round("weighted_agreement", 9).alias("weighted_agreement"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {POOL} " + " UNION ALL ".join(f"SELECT '{p.name}' AS policy, path, count(*) AS n, round(sum(({_weights_sql(p)})::DOUBLE / 1e12) / 1e6, 3) AS weight FROM pool GROUP BY path" for p in voting.POLICIES))
def a5_candidate_weights(t: Tables) -> DataFrame:
    rows = t.pool.withColumns({"conflict": F.expr(_CONFLICT), "marked_last": F.col("trace") % 3 == 0})
    out = None
    for p in voting.POLICIES:
        one = rows.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum(p.weight().cast("double") / 1e12) / 1e6, 3).alias("weight")).select(F.lit(p.name).alias("policy"), "path", "n", "weight")
        out = one if out is None else out.unionByName(one)
    return out


_GEO = f"""WITH {POOL}, s AS (SELECT *, CASE WHEN id % 97 = 0 AND sample_index = 0 THEN 'NaN'::DOUBLE ELSE score END AS sc FROM pool),
 a AS (SELECT id, answer, count(*) AS n, min(sample_index) AS f, count(*) FILTER (WHERE isnan(sc)) AS odd, avg(CASE WHEN isnan(sc) THEN NULL ELSE ln(greatest(least(sc, 1 - 1e-6), 1e-6)) END) AS m FROM s GROUP BY 1, 2),
 w AS (SELECT *, round(n * exp(m), 9) AS w FROM a)"""


@query(f"{_GEO} SELECT id, CASE WHEN sum(odd) > 0 THEN first(answer ORDER BY n DESC, f) FILTER (WHERE answer IS NOT NULL) ELSE first(answer ORDER BY w DESC, f) FILTER (WHERE answer IS NOT NULL) END AS answer, sum(odd) > 0 AS fallback FROM w GROUP BY id")
def a6_geometric_vote(t: Tables) -> DataFrame:
    nan = F.when((F.col("id") % 97 == 0) & (F.col("sample_index") == 0), F.lit(float("nan"))).otherwise(F.col("score"))
    return voting.geometric_vote(t.pool.withColumn("score", nan)).select("id", "answer", "fallback")


@query(f"WITH {POOL} SELECT id, first(answer ORDER BY score DESC, sample_index) AS answer FROM pool GROUP BY id")
def a7_best_scored(t: Tables) -> DataFrame:
    return voting.best_scored(t.pool)


_PLACES = f"{POOL}, q AS (SELECT *, arm * 32 + sample_index AS place FROM pool)"


@query(f"WITH {_PLACES}, a AS (SELECT id, answer, count(*) AS n, min(place) AS f FROM q GROUP BY 1, 2) SELECT id, first(answer ORDER BY n DESC, f) FILTER (WHERE answer IS NOT NULL) AS answer, coalesce(len(list(n) FILTER (WHERE answer IS NOT NULL)) > 1 AND (list(n ORDER BY n DESC) FILTER (WHERE answer IS NOT NULL))[1] = (list(n ORDER BY n DESC) FILTER (WHERE answer IS NOT NULL))[2], false) AS tie, coalesce(sum(n) FILTER (WHERE answer IS NOT NULL), 0)::BIGINT AS valid FROM a GROUP BY id")
def a8_flat_multi_arm(t: Tables) -> DataFrame:
    return voting.flat_vote(t.pool)


@query(f"""WITH {_PLACES}, c AS (SELECT id, arm, answer, count(*) AS n, min(place) AS f FROM q WHERE answer IS NOT NULL GROUP BY 1, 2, 3), d AS (SELECT *, sum(n) OVER (PARTITION BY id, arm)::BIGINT AS valid FROM c),
 s AS (SELECT id, answer, sum(n * (144403552893600 // valid))::BIGINT AS units, min(f) AS f FROM d GROUP BY 1, 2), v AS (SELECT id, first(answer ORDER BY units DESC, f) AS answer, max(units) AS units FROM s GROUP BY id)
 SELECT p.id, answer, units FROM (SELECT DISTINCT id FROM pool) p LEFT JOIN v USING (id)""")
def a9_arm_normalised_vote(t: Tables) -> DataFrame:
    return voting.arm_normalised_vote(t.pool)


_FEATURES = f"""{VOTES}, f AS (SELECT id, answer, count(*) AS support, count(DISTINCT trace) AS unique_traces, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 6) AS median_score, min(score) AS min_score,
 round(stddev_pop(score), 6) AS std_score, min(sample_index) AS first_index, round(avg(CASE WHEN hit_max THEN 1 ELSE 0 END), 6) AS hit_max_rate FROM pool WHERE answer IS NOT NULL GROUP BY 1, 2)"""


@query(f"{_FEATURES} SELECT f.*, top - second AS margin, round((total - valid) / total, 6) AS invalid_rate FROM f JOIN (SELECT id, top, second, total, valid FROM maj) USING (id)")
def a10_answer_group_features(t: Tables) -> DataFrame:
    f = voting.answer_groups(t.pool)
    return f.drop("var_score").withColumns({c: F.round(c, 6) for c in ("mean_score", "median_score", "std_score", "hit_max_rate", "invalid_rate")})


@query(f"{VOTES} SELECT id, answer, top, second, top - second AS margin, (SELECT count(*) FROM g WHERE g.id = maj.id AND g.answer IS NOT NULL) AS distinct_answers, round((top - second) / valid, 9) AS normalised_margin, round(top / valid, 9) AS top_share FROM maj WHERE valid > 0")
def a11_vote_evidence(t: Tables) -> DataFrame:
    kinds = t.pool.groupBy("id").agg(F.count_distinct("answer").alias("distinct_answers"))
    v = voting.majority(t.pool).where("valid > 0").join(kinds, "id")
    return v.select("id", "answer", "top", "second", (F.col("top") - F.col("second")).alias("margin"), "distinct_answers", F.round((F.col("top") - F.col("second")) / F.col("valid"), 9).alias("normalised_margin"), F.round(F.col("top") / F.col("valid"), 9).alias("top_share"))


_OUTCOMES = f"o AS (SELECT id, max(CASE WHEN sample_index = 0 THEN coalesce(answer = gold, false) END) AS greedy, max(coalesce(answer = gold, false)) AS passed, count(*) FILTER (WHERE answer = gold) AS c, count(*) AS k FROM pool JOIN gold USING (id) GROUP BY id)"


@query(f"""{VOTES}, {_OUTCOMES}, p AS (SELECT round(avg(tokens), 6) AS mean_tokens, median(tokens) AS median_tokens, round(quantile_cont(tokens, 0.95), 6) AS p95_tokens, round(avg(CASE WHEN answer IS NULL THEN 1 ELSE 0 END), 9) AS invalid_rate, count(*) AS candidates FROM pool)
 SELECT count(*) AS questions, round(avg(greedy::INT), 9) AS greedy_accuracy, round(sum(c) / sum(k), 9) AS sample_accuracy, round(avg(passed::INT), 9) AS pass_rate, round(avg(CASE WHEN answer = gold THEN 1 ELSE 0 END), 9) AS majority_accuracy, round(avg(top / total), 9) AS agreement, round(avg((top > 0 AND top = second)::INT), 9) AS tie_rate, any_value(mean_tokens) AS mean_tokens, any_value(median_tokens) AS median_tokens, any_value(p95_tokens) AS p95_tokens, any_value(invalid_rate) AS invalid_rate, any_value(candidates) AS candidates
 FROM o JOIN maj USING (id) JOIN gold USING (id) CROSS JOIN p""")
def a12_evaluation_report(t: Tables) -> DataFrame:
    per = metrics.question_outcomes(t.pool, t.gold).join(_judged(t, voting.majority(t.pool)), "id")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
    top = per.agg(F.count("*").alias("questions"), rate("greedy").alias("greedy_accuracy"), F.round(F.sum("c") / F.sum("k"), 9).alias("sample_accuracy"), rate("passed").alias("pass_rate"), rate("correct").alias("majority_accuracy"), F.round(F.avg("agreement"), 9).alias("agreement"), rate("tie").alias("tie_rate"))
    low = t.pool.agg(F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.percentile("tokens", F.lit(0.5)).alias("median_tokens"), F.round(F.percentile("tokens", F.lit(0.95)), 6).alias("p95_tokens"), F.round(F.avg(F.col("answer").isNull().cast("int")), 9).alias("invalid_rate"), F.count("*").alias("candidates"))
    return top.crossJoin(low)


@query(f"{VOTES} SELECT coalesce(segment, 'all') AS segment, CASE WHEN GROUPING(nation) = 1 THEN -1 ELSE nation END AS nation, count(*) FILTER (WHERE answer = gold) AS correct, count(*) AS total, round(avg(CASE WHEN answer = gold THEN 1 ELSE 0 END), 9) AS accuracy FROM maj JOIN gold USING (id) JOIN (SELECT c_custkey AS customer, c_nationkey AS nation FROM customer) USING (customer) GROUP BY GROUPING SETS ((segment), (nation), ())")
def a13_segment_tables(t: Tables) -> DataFrame:
    rows = _judged(t, voting.majority(t.pool)).join(t.customer.select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")), "customer")
    return rows.groupingSets([("segment",), ("nation",), ()], "segment", "nation").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"), F.grouping("nation").alias("_g")).select(F.coalesce("segment", F.lit("all")).alias("segment"), F.when(F.col("_g") == 1, -1).otherwise(F.col("nation")).alias("nation"), "correct", "total", "accuracy")


@query(f"""WITH {POOL}, ks AS (SELECT unnest([1, 2, 4, 8]) AS k), g AS (SELECT k, id, answer, count(*) AS n, min(sample_index) AS f FROM pool JOIN ks ON sample_index < k GROUP BY 1, 2, 3),
 m AS (SELECT k, id, first(answer ORDER BY n DESC, f) FILTER (WHERE answer IS NOT NULL) AS answer, max(answer = gold) AS passed FROM g JOIN gold USING (id) GROUP BY 1, 2)
 SELECT k, count(*) AS questions, round(avg(CASE WHEN answer = gold THEN 1 ELSE 0 END), 9) AS majority_accuracy, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 9) AS pass_rate FROM m JOIN gold USING (id) GROUP BY k""")
def a14_k_sweep(t: Tables) -> DataFrame:
    ks = F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("k")
    rows = t.pool.select("*", ks).where(F.col("sample_index") < F.col("k"))
    g = rows.groupBy("k", "id", "answer").agg(F.count("*").alias("n"), F.min("sample_index").alias("f")).join(t.gold.select("id", "gold"), "id")
    m = g.groupBy("k", "id", "gold").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct("n", -F.col("f")))).alias("answer"), F.max(F.col("answer") == F.col("gold")).alias("passed"))
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 9)
    return m.groupBy("k").agg(F.count("*").alias("questions"), rate(F.col("answer") == F.col("gold")).alias("majority_accuracy"), rate(F.col("passed")).alias("pass_rate"))


@query(f"WITH {POOL} SELECT path, answer IS NULL AS invalid, count(*) AS n FROM pool GROUP BY 1, 2")
def a15_histogram(t: Tables) -> DataFrame:
    return t.pool.groupBy("path", F.col("answer").isNull().alias("invalid")).agg(F.count("*").alias("n"))


@query("SELECT concat_ws('|', CASE WHEN l_tax > 0.04 THEN 'tax' END, CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity > 25 THEN 'large' END) AS pattern, count(*) AS n FROM lineitem GROUP BY 1")
def a16_membership_patterns(t: Tables) -> DataFrame:
    flag = lambda c, v, n: F.when(F.col(c) > v, n)
    return t.lineitem.groupBy(F.concat_ws("|", flag("l_tax", 0.04, "tax"), flag("l_discount", 0.05, "discount"), flag("l_quantity", 25, "large")).alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY 1")
def a17_a18_distributions(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.percentile("l_extendedprice", F.lit(q)), 6)
    return t.lineitem.groupBy("l_returnflag").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n"))


@query(f"{VOTES}, q AS (SELECT id, round(avg(CASE WHEN answer = gold AND NOT hit_max THEN 1 ELSE 0 END), 9) AS share, max(coalesce(answer = gold AND NOT hit_max, false)) AS passed, count(DISTINCT answer) AS kinds, count(*) FILTER (WHERE answer = gold) AS c FROM pool JOIN gold USING (id) GROUP BY id) SELECT id, share, passed, kinds, c, coalesce(answer = gold, false) AS majority_correct, top > 0 AND top = second AS tie FROM q JOIN maj USING (id) JOIN gold USING (id)")
def a19_a20_a32_sample_quality(t: Tables) -> DataFrame:
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    q = t.pool.join(t.gold.select("id", "gold"), "id").groupBy("id").agg(F.round(F.avg((hit & ~F.col("hit_max")).cast("int")), 9).alias("share"), F.max(hit & ~F.col("hit_max")).alias("passed"), F.count_distinct("answer").alias("kinds"), F.count_if(hit).alias("c"))
    return q.join(_judged(t, voting.majority(t.pool)).select("id", F.col("correct").alias("majority_correct"), "tie"), "id")


_SCORED = "x AS (SELECT doc_id, lang, source, toxic AS y, (doc_id * 37 % 101) / 100.0 + toxic * 0.1 AS s, least((doc_id * 37 % 101) / 110.0 + toxic * 0.08, 1.0) AS p, n_chars FROM labels JOIN documents USING (doc_id))"


def _scored(t: Tables) -> DataFrame:
    base = F.col("doc_id") * 37 % 101
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", "n_chars", F.col("toxic").alias("y"), (base / 100.0 + F.col("toxic") * 0.1).alias("s"), F.least(base / 110.0 + F.col("toxic") * 0.08, F.lit(1.0)).alias("p"))


@query(f"WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM x) SELECT round((sum(ar) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r")
def a21_roc_auc(t: Tables) -> DataFrame:
    return metrics.auc(_scored(t), "y", "s").select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_SCORED}, r AS (SELECT y, sum(y) OVER w / count(*) OVER w AS pr FROM x WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(CASE WHEN y = 1 THEN pr END) / sum(y), 9) AS average_precision FROM r")
def a22_average_precision(t: Tables) -> DataFrame:
    return metrics.average_precision(_scored(t), "y", "s", "doc_id").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {_SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(y) AS y, avg(p) AS p FROM x GROUP BY 1) SELECT (SELECT round(avg((p - y) * (p - y)), 9) FROM x) AS brier, round(sum(n * abs(y - p)) / sum(n), 9) AS ece FROM b")
def a23_brier_ece(t: Tables) -> DataFrame:
    rows = _scored(t)
    return metrics.brier(rows, "y", "p").crossJoin(metrics.ece(rows, "y", "p")).select(F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


@query(f"WITH {_SCORED}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS ar FROM x), a AS (SELECT source, sum(y) AS p, count(*) - sum(y) AS q, sum(CASE WHEN y = 1 THEN ar END) AS ra FROM r GROUP BY 1) SELECT count(*) AS groups, round(avg((ra - p * (p + 1) / 2.0) / (p * q)), 9) AS macro_auc FROM a WHERE p > 0 AND q > 0")
def a24_within_group_auc(t: Tables) -> DataFrame:
    return metrics.auc(_scored(t), "y", "s", ("source",)).where("auc IS NOT NULL").agg(F.count("*").alias("groups"), F.round(F.avg("auc"), 9).alias("macro_auc"))


@query(f"WITH {_SCORED}, m AS (SELECT avg(n_chars) FILTER (WHERE y = 1) AS a, avg(n_chars) FILTER (WHERE y = 0) AS b, var_pop(n_chars) FILTER (WHERE y = 1) AS va, var_pop(n_chars) FILTER (WHERE y = 0) AS vb FROM x), c AS (SELECT lang, count(*) FILTER (WHERE y = 1) / (SELECT sum(y) FROM x) AS p, count(*) FILTER (WHERE y = 0) / (SELECT count(*) - sum(y) FROM x) AS q FROM x GROUP BY lang) SELECT 'n_chars' AS feature, round((a - b) / sqrt((va + vb) / 2), 6) AS smd FROM m UNION ALL SELECT lang, round((p - q) / sqrt((p * (1 - p) + q * (1 - q)) / 2), 6) FROM c")
def a25_standardised_mean_differences(t: Tables) -> DataFrame:
    rows = _scored(t)
    number = metrics.numeric_smd(rows, "y", "n_chars").select(F.lit("n_chars").alias("feature"), F.round("smd", 6).alias("smd"))
    return number.unionByName(metrics.categorical_smd(rows, "y", "lang").select(F.col("lang").alias("feature"), F.round("smd", 6).alias("smd")))


@query(f"WITH {_SCORED} SELECT source, count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) <> count(*) FILTER (WHERE y = 1) AS unbalanced FROM x GROUP BY 1")
def a26_source_label_balance(t: Tables) -> DataFrame:
    return _scored(t).groupBy("source").pivot("y", [0, 1]).count().select("source", F.coalesce("0", F.lit(0)).cast("long").alias("negatives"), F.coalesce("1", F.lit(0)).cast("long").alias("positives")).withColumn("unbalanced", F.col("negatives") != F.col("positives"))


@query(f"WITH {POOL}, s AS (SELECT id, arm, coalesce(answer = gold, false) AS y FROM pool JOIN gold USING (id)), c AS (SELECT id, y, list_sort(list(DISTINCT arm)) AS arms FROM s GROUP BY 1, 2) SELECT y, arms[1] AS arm, count(*) AS mandatory FROM c WHERE len(arms) = 1 GROUP BY 1, 2")
def a27_capacity_certificate(t: Tables) -> DataFrame:
    s = t.pool.join(t.gold.select("id", "gold"), "id").select("id", "arm", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("y"))
    return s.groupBy("id", "y").agg(F.collect_set("arm").alias("arms")).where(F.size("arms") == 1).groupBy("y", F.col("arms")[0].alias("arm")).agg(F.count("*").alias("mandatory"))


@query(f"{VOTES}, r AS (SELECT g.id, g.answer, n, rank() OVER (PARTITION BY g.id ORDER BY n DESC) AS rk FROM g WHERE answer IS NOT NULL), c AS (SELECT gold.id, min(rk) AS rk FROM gold JOIN (SELECT DISTINCT id FROM pool) USING (id) LEFT JOIN r ON r.id = gold.id AND r.answer = gold.gold GROUP BY 1) SELECT count(*) AS questions, count(rk) AS any_correct, count(*) FILTER (WHERE rk = 1) AS rank1, count(*) FILTER (WHERE rk <= 2) AS rank2, count(*) FILTER (WHERE rk <= 3) AS rank3 FROM c")
def a28_oracle_ceilings(t: Tables) -> DataFrame:
    g = t.pool.where("answer is not null").groupBy("id", "answer").agg(F.count("*").alias("n"))
    ranked = g.withColumn("rk", F.rank().over(W.partitionBy("id").orderBy(F.desc("n"))))
    c = t.gold.select("id", F.col("gold").alias("answer")).join(t.pool.select("id").distinct(), "id", "left_semi").join(ranked, ["id", "answer"], "left")
    return c.agg(F.count("*").alias("questions"), F.count("rk").alias("any_correct"), *(F.count_if(F.col("rk") <= r).alias(f"rank{r}") for r in (1, 2, 3)))


_TWO = f"{POOL}, {GROUPS}, {MAJORITY}, b AS (SELECT id, first(answer ORDER BY score DESC, sample_index) AS best FROM pool GROUP BY id), w AS (SELECT id, answer AS a, best AS b, gold, coalesce(answer = gold, false) AS ca, coalesce(best = gold, false) AS cb FROM maj JOIN b USING (id) JOIN gold USING (id))"


def _two(t: Tables) -> DataFrame:
    a = voting.majority(t.pool).select("id", F.col("answer").alias("a"))
    b = voting.best_scored(t.pool).select("id", F.col("answer").alias("b"))
    right = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    return a.join(b, "id").join(t.gold.select("id", "gold"), "id").withColumns({"ca": right("a"), "cb": right("b")})


@query(f"WITH {_TWO} SELECT CASE WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' WHEN NOT ca AND cb THEN 'rescue' WHEN ca THEN 'break' ELSE 'wrong_to_wrong' END AS outcome, count(*) AS n FROM w GROUP BY 1")
def a29_outcome_decomposition(t: Tables) -> DataFrame:
    kind = F.when(F.col("a").eqNullSafe(F.col("b")), "unchanged").when(~F.col("ca") & F.col("cb"), "rescue").when(F.col("ca"), "break").otherwise("wrong_to_wrong")
    return _two(t).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_TWO} SELECT round(avg((a IS NOT DISTINCT FROM b)::INT), 9) AS agreement, round(avg((a = b)::INT), 9) AS valid_agreement, count(*) AS n FROM w")
def a30_policy_agreement(t: Tables) -> DataFrame:
    return _two(t).agg(F.round(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")), 9).alias("agreement"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 9).alias("valid_agreement"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS makespan, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS throughput FROM events GROUP BY 1")
def a31_makespan(t: Tables) -> DataFrame:
    seconds = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 - F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), seconds.alias("makespan"), F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 9).alias("throughput"))


@query(f"WITH {_TWO}, d AS (SELECT count(*) FILTER (WHERE ca AND NOT cb) AS only_a, count(*) FILTER (WHERE cb AND NOT ca) AS only_b, count(*) AS n FROM w), i AS (SELECT unnest(range(least(only_a, only_b) + 1)) AS i, only_a + only_b AS m FROM d) SELECT only_a, only_b, n, round((only_a - only_b) / n, 9) AS difference, round(least(1, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) FROM i)), 6) AS p_value FROM d")
def m1_mcnemar(t: Tables) -> DataFrame:
    return metrics.mcnemar(_two(t), "ca", "cb").withColumns({"difference": F.round("difference", 9), "p_value": F.round("p_value", 6)})


@query()
def m2_paired_bootstrap(t: Tables) -> DataFrame:
    return metrics.paired_bootstrap(_two(t), "ca", "cb")


@query(f"{VOTES}, c AS (SELECT segment, count(*) FILTER (WHERE answer = gold) AS s, count(*) AS n, 1.959963984540054 AS z FROM maj JOIN gold USING (id) GROUP BY 1) SELECT segment, s, n, round((s / n + z * z / (2 * n) - z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((s / n + z * z / (2 * n) + z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM c")
def m3_wilson(t: Tables) -> DataFrame:
    c = _judged(t, voting.majority(t.pool)).groupBy("segment").agg(F.count_if("correct").alias("s"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("s"), F.col("n"))
    return c.select("segment", "s", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_GRID = "grid AS (SELECT a.v * 100 + b.v * 10 + c.v AS policy, a.v AS wf, b.v AS wb, c.v AS wl FROM (SELECT unnest([1, 2, 4]) AS v) a, (SELECT unnest([0, 1, 2]) AS v) b, (SELECT unnest([0, 1]) AS v) c)"
_GRID_CORRECT = f"""{POOL}, {_GRID}, cat AS (SELECT id, answer, path, count(*) AS n, min(sample_index) AS f FROM pool WHERE answer IS NOT NULL GROUP BY 1, 2, 3),
 sc AS (SELECT policy, id, answer, sum(n * CASE path WHEN 'final_answer_marker' THEN wf WHEN 'boxed' THEN wb ELSE wl END) AS w, min(f) FILTER (WHERE CASE path WHEN 'final_answer_marker' THEN wf WHEN 'boxed' THEN wb ELSE wl END > 0) AS f FROM cat CROSS JOIN grid GROUP BY 1, 2, 3),
 pr AS (SELECT policy, id, first(answer ORDER BY w DESC, f) FILTER (WHERE w > 0) AS answer FROM sc GROUP BY 1, 2),
 ok AS (SELECT policy, id, coalesce(answer = gold, false)::INT AS y FROM pr JOIN gold USING (id))"""


def _grid(t: Tables) -> DataFrame:
    """(policy, id, y): the pool is first reduced to counts by (id, answer, path), then met by the small grid."""
    grid = t.spark.sql("SELECT a * 100 + b * 10 + c AS policy, a AS wf, b AS wb, c AS wl FROM (SELECT explode(array(1, 2, 4)) AS a) CROSS JOIN (SELECT explode(array(0, 1, 2)) AS b) CROSS JOIN (SELECT explode(array(0, 1)) AS c)")
    cat = t.pool.where("answer is not null").groupBy("id", "answer", "path").agg(F.count("*").alias("n"), F.min("sample_index").alias("f"))
    w = F.when(F.col("path") == "final_answer_marker", F.col("wf")).when(F.col("path") == "boxed", F.col("wb")).otherwise(F.col("wl"))
    scored = cat.crossJoin(F.broadcast(grid)).withColumn("w", w).groupBy("policy", "id", "answer").agg(F.sum(F.col("n") * F.col("w")).alias("w"), F.min(F.when(F.col("w") > 0, F.col("f"))).alias("f"))
    won = scored.groupBy("policy", "id").agg(F.max_by("answer", F.when(F.col("w") > 0, F.struct("w", -F.col("f")))).alias("answer"))
    return won.join(t.gold.select("id", "gold"), "id").select("policy", "id", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("int").alias("y"))


@query(f"WITH {_GRID_CORRECT} SELECT policy, sum(y)::BIGINT AS correct, count(*) AS n FROM ok GROUP BY policy")
def j16_policy_grid(t: Tables) -> DataFrame:
    return _grid(t).groupBy("policy").agg(F.sum("y").alias("correct"), F.count("*").alias("n"))


@query(f"WITH {_GRID_CORRECT}, f AS (SELECT id % 5 AS fold, policy, sum(y)::BIGINT AS y, count(*) AS n FROM ok GROUP BY 1, 2), tr AS (SELECT fold, policy, y, n, sum(y) OVER (PARTITION BY policy) - y AS train FROM f) SELECT fold, first(policy ORDER BY train DESC, policy) AS policy, first(y ORDER BY train DESC, policy) AS correct, first(n ORDER BY train DESC, policy) AS n FROM tr GROUP BY fold")
def m4_t3_out_of_fold_selection(t: Tables) -> DataFrame:
    by_fold = _grid(t).groupBy((F.col("id") % 5).alias("fold"), "policy").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    train = by_fold.withColumn("train", F.sum("y").over(W.partitionBy("policy")) - F.col("y"))
    best = train.groupBy("fold").agg(F.max_by(F.struct("policy", "y", "n"), F.struct("train", -F.col("policy"))).alias("b"))
    return best.select("fold", F.col("b.policy").alias("policy"), F.col("b.y").alias("correct"), F.col("b.n").alias("n"))


@query(f"WITH {_SCORED}, f AS (SELECT doc_id % 4 AS fold, lang, y FROM x), c AS (SELECT fold, lang, sum(y) AS s, count(*) AS n FROM f GROUP BY 1, 2), e AS (SELECT fold, lang, (sum(s) OVER (PARTITION BY lang) - s + 2 * (SELECT avg(y) FROM x)) / (sum(n) OVER (PARTITION BY lang) - n + 2) AS p FROM c), r AS (SELECT y, rank() OVER (ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY round(p, 12)) - 1) / 2.0 AS ar FROM f JOIN e USING (fold, lang)) SELECT round((sum(ar) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def m5_shortcut_probe(t: Tables) -> DataFrame:
    f = _scored(t).select((F.col("doc_id") % 4).alias("fold"), "lang", "y")
    c = f.groupBy("fold", "lang").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    others = lambda col: F.sum(col).over(W.partitionBy("lang")) - F.col(col)
    e = c.crossJoin(F.broadcast(f.agg(F.avg("y").alias("m")))).select("fold", "lang", F.round((others("s") + 2 * F.col("m")) / (others("n") + 2), 12).alias("p"))
    return metrics.auc(f.join(e, ["fold", "lang"]), "y", "p").select(F.round("auc", 6).alias("auc"))


_OVERRIDE = f"{_TWO}, i AS (SELECT w.id, a AS raw_answer, b AS orm_answer, (top - second) / valid AS margin, coalesce((SELECT n FROM g WHERE g.id = w.id AND g.answer = w.b), 0) / valid AS support_share, top / valid AS top_share, (w.id % 10) / 10.0 AS gap FROM w JOIN maj ON maj.id = w.id WHERE valid > 0)"


@query(f"""WITH {_OVERRIDE}, c AS (SELECT *, list_filter([CASE WHEN raw_answer IS NOT DISTINCT FROM orm_answer THEN 'orm_differs_from_raw' END, CASE WHEN NOT margin <= 0.4 THEN 'raw_top2_margin_at_most_m_max' END, CASE WHEN NOT support_share >= 0.2 THEN 'orm_alternative_support_at_least_n_min' END, CASE WHEN NOT gap >= 0.3 THEN 'group_score_gap_at_least_g_min' END, CASE WHEN NOT top_share <= 0.6 THEN 'raw_top_vote_share_at_most_r_max' END], lambda x: x IS NOT NULL) AS failed FROM i)
 SELECT id, raw_answer, orm_answer, CASE WHEN len(failed) = 0 THEN orm_answer ELSE raw_answer END AS final_answer, len(failed) = 0 AS overridden, CASE WHEN len(failed) = 0 THEN 'all_conditions_passed' ELSE 'preserve_raw:' || array_to_string(failed, ',') END AS reason FROM c""")
def p17_selective_override(t: Tables) -> DataFrame:
    votes = voting.majority(t.pool).where("valid > 0")
    groups = t.pool.where("answer is not null").groupBy("id", F.col("answer").alias("b")).agg(F.count("*").alias("n"))
    i = _two(t).join(votes.select("id", "top", "second", "valid"), "id").join(groups, ["id", "b"], "left")
    i = i.select("id", F.col("a").alias("raw_answer"), F.col("b").alias("orm_answer"), ((F.col("top") - F.col("second")) / F.col("valid")).alias("margin"), (F.coalesce("n", F.lit(0)) / F.col("valid")).alias("support_share"), (F.col("top") / F.col("valid")).alias("top_share"), ((F.col("id") % 10) / 10.0).alias("gap"))
    return voting.override(i, 0.4, 0.2, 0.3, 0.6)


@query(f"WITH {_TWO}, d AS (SELECT count(*) FILTER (WHERE ca) AS a, count(*) FILTER (WHERE cb) AS b, count(*) AS n FROM w) SELECT a, b, n, CASE WHEN b > a AND (b - a) / n >= 0.01 THEN 'PASS' WHEN b >= a THEN 'HOLD' ELSE 'REJECT' END AS decision FROM d")
def p18_threshold_gate(t: Tables) -> DataFrame:
    d = _two(t).agg(F.count_if("ca").alias("a"), F.count_if("cb").alias("b"), F.count("*").alias("n"))
    gain = (F.col("b") - F.col("a")) / F.col("n")
    return d.withColumn("decision", F.when((gain > 0) & (gain >= 0.01), "PASS").when(gain >= 0, "HOLD").otherwise("REJECT"))


@query(f"WITH {POOL} SELECT coalesce(e.id, h.id) AS id, h.id IS NULL AS missing, e.id IS NULL AS extra, coalesce(h.samples, 0) AS samples FROM (SELECT id FROM gold WHERE id % 7 <> 0) e FULL JOIN (SELECT id, count(DISTINCT CASE WHEN sample_index < 4 THEN sample_index END) AS samples FROM pool WHERE id % 5 <> 0 GROUP BY 1) h ON e.id = h.id")
def j3_coverage_report(t: Tables) -> DataFrame:
    return coverage(t.pool.where("id % 5 <> 0"), t.gold.where("id % 7 <> 0"), 4)


@query(f"WITH {POOL} SELECT id, sample_index, answer, gold, coalesce(answer = gold, false) AS correct FROM pool JOIN gold USING (id)")
def j1_pool_with_gold(t: Tables) -> DataFrame:
    return t.pool.join(t.gold, "id").select("id", "sample_index", "answer", "gold", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("correct"))


@query(f"WITH {POOL} SELECT id, sample_index, answer, score FROM pool")
def j2_scores_by_sample(t: Tables) -> DataFrame:
    """Scores of every sample, and an error unless both sides have the same keys."""
    return scored(t.pool.select("id", "sample_index", "answer"), t.pool.select("id", "sample_index", "score"))


@query(f"WITH {POOL}, r AS (SELECT * FROM pool WHERE sample_index < 4) SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS pairs, round(avg((a.answer IS NOT DISTINCT FROM b.answer)::INT), 9) AS agreement FROM r a JOIN r b ON a.id = b.id AND a.arm < b.arm GROUP BY 1, 2")
def j12_u8_inter_arm_agreement(t: Tables) -> DataFrame:
    """Pairs are counted, not built: answers of an arm in a question are grouped before the arms meet."""
    g = t.pool.where("sample_index < 4").groupBy("id", "arm", "answer").agg(F.count("*").alias("n"))
    size = g.groupBy("id", "arm").agg(F.sum("n").alias("n"))
    side = lambda d, s, *keep: d.select("id", F.col("arm").alias(f"arm_{s}"), *(F.col(k).alias(f"{k}_{s}") for k in keep))
    all_ = side(size, "a", "n").join(side(size, "b", "n"), "id").where("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))
    same = side(g, "a", "n", "answer").join(side(g, "b", "n", "answer").withColumnRenamed("id", "id_b"), F.expr("id = id_b AND answer_a <=> answer_b AND arm_a < arm_b")).groupBy("arm_a", "arm_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("same"))
    return all_.join(same, ["arm_a", "arm_b"], "left").select("arm_a", "arm_b", "pairs", F.round(F.coalesce("same", F.lit(0)) / F.col("pairs"), 9).alias("agreement"))


@query(f"WITH {_TWO} SELECT ca, cb, count(*) AS n FROM w GROUP BY 1, 2")
def j17_paired_predictions(t: Tables) -> DataFrame:
    return _two(t).groupBy("ca", "cb").agg(F.count("*").alias("n"))


@query(f"WITH {POOL} SELECT id, sample_index, answer FROM pool WHERE sample_index < 3")
def w1_prefix(t: Tables) -> DataFrame:
    return prefix(t.pool, 3).select("id", "sample_index", "answer")


@query(f"WITH {POOL} SELECT id, sample_index, answer FROM pool WHERE arm = 0 UNION ALL SELECT id, sample_index + 32, answer FROM pool WHERE arm = 1 UNION ALL SELECT id, sample_index + 64, answer FROM pool WHERE arm = 2")
def u2_j19_union_with_offset(t: Tables) -> DataFrame:
    return union_pools([t.pool.where(F.col("arm") == a) for a in range(3)], 32).select("id", "sample_index", "answer")


@query(f"WITH {POOL} SELECT id, sample_index, answer, 'a' AS source FROM pool WHERE sample_index < 2 UNION ALL SELECT id, sample_index, CAST(trace % 5 AS VARCHAR), 'b' FROM pool WHERE sample_index >= 2")
def u3_prefix_splice(t: Tables) -> DataFrame:
    a = t.pool.select("id", "sample_index", "answer", F.lit("a").alias("source"))
    b = t.pool.select("id", "sample_index", (F.col("trace") % 5).cast("string").alias("answer"), F.lit("b").alias("source"))
    return splice(a, b, 2)


@query(f"WITH {POOL}, s AS (SELECT id, count(*) = 2 AND count(answer) = 2 AND count(DISTINCT answer) = 1 AS stop FROM pool WHERE sample_index < 2 GROUP BY id) SELECT stop, count(*) AS questions, sum(n)::BIGINT AS samples, sum(CASE WHEN stop THEN 2 ELSE n END)::BIGINT AS spent FROM s JOIN (SELECT id, count(*) AS n FROM pool GROUP BY 1) USING (id) GROUP BY stop")
def incremental_adaptive_sampling(t: Tables) -> DataFrame:
    n = t.pool.groupBy("id").agg(F.count("*").alias("n"))
    return unanimous(t.pool, 2).join(n, "id").groupBy("stop").agg(F.count("*").alias("questions"), F.sum("n").alias("samples"), F.sum(F.when(F.col("stop"), 2).otherwise(F.col("n"))).alias("spent"))


@query(f"{VOTES}, b AS (SELECT id, first(answer ORDER BY score DESC, sample_index) FILTER (WHERE hit_max) AS answer FROM pool GROUP BY id) SELECT maj.id, coalesce(b.answer, maj.answer) AS answer, CASE WHEN b.answer IS NOT NULL THEN 1 WHEN maj.answer IS NOT NULL THEN 2 END AS stage FROM maj LEFT JOIN b USING (id)")
def w12_two_stage_fallback(t: Tables) -> DataFrame:
    return voting.two_stage_fallback(voting.best_scored(t.pool.where("hit_max")), voting.majority(t.pool))


@query(f"{VOTES} SELECT id, coalesce(answer, '0') AS answer FROM maj")
def pipeline_submission(t: Tables) -> DataFrame:
    return voting.majority(t.pool).select("id", F.coalesce("answer", F.lit("0")).alias("answer"))


@query()
def m6_group_selector(t: Tables) -> DataFrame:
    from quorumlake.plans.selector import cross_fitted_choice

    return cross_fitted_choice(voting.answer_groups(t.pool), t.gold)
