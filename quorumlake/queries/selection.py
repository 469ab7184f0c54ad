"""Caps, strata, holdouts, folds, shards, batches, packing, pairs, sets and the incremental forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import stable_hash
from quorumlake.operators import selection as X
from quorumlake.queries.registry import POOL, Tables, query
from quorumlake.streaming import incremental

_H = "sha256(concat_ws(chr(31), {}))"


@query(f"WITH {POOL}, r AS (SELECT id, sample_index, tokens, row_number() OVER (PARTITION BY id ORDER BY tokens, sample_index) AS rn FROM pool WHERE answer IS NOT NULL) SELECT id, sample_index, tokens FROM r WHERE rn <= 2")
def w2_capped_shortest_first(t: Tables) -> DataFrame:
    return X.top_n(t.pool.where("answer is not null").select("id", "sample_index", "tokens"), ["id"], ["tokens", "sample_index"], 2)


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: round_even(k * (n - 1) / 4.0, 0)::BIGINT), i)")
def w3_evenly_spaced(t: Tables) -> DataFrame:
    return X.evenly_spaced(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"], 5).select("source", "doc_id")


@query("WITH p AS (SELECT source, quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN n_chars <= q[1] THEN 'q1' WHEN n_chars <= q[2] THEN 'q2' WHEN n_chars <= q[3] THEN 'q3' ELSE 'q4' END AS quartile FROM documents JOIN p USING (source)")
def w6_source_quartiles(t: Tables) -> DataFrame:
    q = t.documents.groupBy("source").agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    n = F.col("n_chars")
    return t.documents.join(F.broadcast(q), "source").select("doc_id", F.when(n <= F.col("q")[0], "q1").when(n <= F.col("q")[1], "q2").when(n <= F.col("q")[2], "q3").otherwise("q4").alias("quartile"))


@query(f"WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {_H.format('7, doc_id')}, doc_id) AS rd FROM documents), p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rd, {_H.format('7, source')}, source) AS pl FROM r) SELECT lang, doc_id FROM p WHERE pl <= 30")
def w7_round_robin_sources(t: Tables) -> DataFrame:
    return X.round_robin(t.documents.select("lang", "source", "doc_id"), ["lang"], "source", "doc_id", 7, 30).select("lang", "doc_id")


@query(f"WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY {_H.format(chr(39) + 'template' + chr(39) + ', 42, source')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT source, n FROM w WHERE b < 200")
def w9_running_holdout(t: Tables) -> DataFrame:
    return X.running_holdout(t.documents.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 42, 200)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_H.format(chr(39) + 'perm' + chr(39) + ', 3, doc_id')}, doc_id) - 1 AS position FROM documents")
def w10_hash_permutation(t: Tables) -> DataFrame:
    return X.hash_order(t.documents.select("doc_id"), "doc_id", "perm", 3)


@query(f"""WITH s AS (SELECT lang, count(*) AS n, floor(count(*) * 0.1) AS wh, count(*) * 0.1 - floor(count(*) * 0.1) AS rest FROM documents GROUP BY 1), q AS (SELECT lang, wh + (row_number() OVER (ORDER BY rest DESC, {_H.format("'stratum', 42, lang")}) <= (SELECT round_even(count(*) * 0.1, 0) FROM documents) - (SELECT sum(wh) FROM s))::INT AS quota FROM s),
 r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format("'random', 42, lang, doc_id")}) AS rn FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE rn <= quota""")
def w13_largest_remainder_holdout(t: Tables) -> DataFrame:
    return X.apportion(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.1, 42).select("doc_id", "lang")


@query(f"""WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 5000 ORDER BY {_H.format("'long', 5, doc_id")}, doc_id LIMIT 20), b AS (SELECT doc_id FROM documents WHERE contains(text, '|') AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY {_H.format("'table', 5, doc_id")}, doc_id LIMIT 15) SELECT doc_id, 'long' AS category FROM a UNION ALL SELECT doc_id, 'table' FROM b""")
def w14_sequential_quotas(t: Tables) -> DataFrame:
    return X.sequential_quotas(t.documents.select("doc_id", "n_chars", "text"), "doc_id", [("long", F.col("n_chars") > 5000, 20), ("table", F.contains("text", F.lit("|")), 15)], 5)


@query()
def w15_balanced_folds(t: Tables) -> DataFrame:
    return X.lpt_folds(t.documents.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 5)


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY {_H.format(chr(39) + 'shard' + chr(39) + ', 9, doc_id')}, doc_id) - 1) % 2 AS shard FROM documents")
def w17_shards(t: Tables) -> DataFrame:
    return X.shards(t.documents.select("doc_id"), "doc_id", 9, 2).select("doc_id", "shard")


@query(f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_H.format(chr(39) + 'epoch' + chr(39) + ', 4, doc_id')}, doc_id) - 1 AS p, count(*) OVER () AS n FROM documents), a AS (SELECT doc_id, p FROM o UNION ALL SELECT doc_id, p + n FROM o WHERE p < (7 - n % 7) % 7) SELECT doc_id, p % 7 AS rank, p // 7 AS step FROM a")
def w18_cyclic_epochs(t: Tables) -> DataFrame:
    return X.cyclic_epochs(t.documents, "doc_id", 4, 7)


@query(f"WITH g AS (SELECT DISTINCT source FROM documents), o AS (SELECT source, row_number() OVER (ORDER BY {_H.format(chr(39) + 'budget' + chr(39) + ', 2, source')}, source) - 1 AS p, count(*) OVER () AS n FROM g) SELECT source, 107 // n + (p < 107 % n)::INT AS share FROM o")
def w20_budget_matched(t: Tables) -> DataFrame:
    return X.budget_matched(t.documents.select("source").distinct(), "source", 107, 2)


@query(f"WITH {POOL}, r AS (SELECT id, sample_index, row_number() OVER (PARTITION BY id ORDER BY {_H.format('id, sample_index')}) AS rn FROM pool WHERE answer IS NOT NULL), c AS (SELECT id, 1 + id % 3 AS slots FROM gold) SELECT id, sample_index FROM r JOIN c USING (id) WHERE rn <= slots")
def w21_capacity_slots(t: Tables) -> DataFrame:
    rows = t.pool.where("answer is not null").select("id", "sample_index").join(t.gold.select("id", (F.col("id") % 3 + 1).alias("slots")), "id")
    return X.top_n(rows, ["id"], [stable_hash(F.col("id"), F.col("sample_index"))], F.col("slots")).select("id", "sample_index")


@query()
def w4_quantile_picks(t: Tables) -> DataFrame:
    return X.quantile_picks(t.documents, ["source"], "doc_id", "n_chars", [0.25, 0.5, 0.75])


@query()
def w19_budget_planner(t: Tables) -> DataFrame:
    """Per-question caps lowered step by step until the long share fits: a loop over thresholds, not over rows."""
    rows = t.pool.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("tokens") > 300).alias("long"))
    totals = rows.agg(*(F.sum(F.least("n", F.lit(c))).alias(f"n{c}") for c in (8, 4, 2, 1)), *(F.sum(F.least("long", F.lit(c))).alias(f"l{c}") for c in (8, 4, 2, 1))).first()
    cap = next((c for c in (8, 4, 2, 1) if (totals[f"l{c}"] or 0) <= 0.5 * (totals[f"n{c}"] or 0)), 1)
    return rows.select("id", F.least("n", F.lit(cap)).alias("selected"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 64")
def t2_global_top(t: Tables) -> DataFrame:
    return t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey").limit(64).select("l_orderkey", "l_extendedprice")


@query("WITH a AS (SELECT doc_id, n_chars > 500 AS ok, count(*) FILTER (WHERE n_chars > 500) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS acc, row_number() OVER (ORDER BY doc_id) AS seen FROM documents), c AS (SELECT min(doc_id) AS cut FROM a WHERE acc >= 50 AND seen >= 60) SELECT doc_id FROM a, c WHERE ok AND doc_id <= coalesce(cut, doc_id)")
def t5_early_stop_scan(t: Tables) -> DataFrame:
    return incremental.accept_until(t.documents, "doc_id", F.col("n_chars") > 500, min_accepted=50, min_seen=60).select("doc_id")


@query()
def t6_token_batches(t: Tables) -> DataFrame:
    return X.token_batches(t.documents.withColumn("tokens", F.ceil(F.col("n_chars") / 4).cast("int")), ["source"], "doc_id", "tokens", 8192)


@query("SELECT n_bucket, count(*) AS rows, ceil(count(*) / 16)::BIGINT AS batches, (ceil(count(*) / 16) * 16 - count(*))::BIGINT AS padding FROM (SELECT (ceil(n_chars / 512) * 512)::BIGINT AS n_bucket FROM documents) GROUP BY 1")
def t7_fixed_shape_buckets(t: Tables) -> DataFrame:
    b = t.documents.groupBy((F.ceil(F.col("n_chars") / 512) * 512).alias("n_bucket")).agg(F.count("*").alias("rows"))
    return b.withColumn("batches", F.ceil(F.col("rows") / 16)).withColumn("padding", F.col("batches") * 16 - F.col("rows"))


@query()
def t8_best_fit_packing(t: Tables) -> DataFrame:
    return X.pack(t.documents.withColumn("tokens", F.ceil(F.col("n_chars") / 4).cast("int")), ["source"], "doc_id", "tokens", 2048)


@query()
def j15_greedy_matching(t: Tables) -> DataFrame:
    return X.greedy_pairs(t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id"), ["source"], "doc_id", "toxic", "n_chars")


_PN = f"{POOL}, y AS (SELECT id, sample_index, tokens, coalesce(answer = gold, false) AS ok FROM pool JOIN gold USING (id))"


@query(f"WITH {_PN}, c AS (SELECT p.id, p.sample_index AS chosen, n.sample_index AS rejected, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.tokens - n.tokens), p.sample_index, n.sample_index) AS rn FROM y p JOIN y n ON p.id = n.id AND p.ok AND NOT n.ok) SELECT id, chosen, rejected FROM c WHERE rn = 1")
def j13_t11_nearest_pair(t: Tables) -> DataFrame:
    return _pairs(t, 1).select("id", "chosen", "rejected")


@query(f"WITH {_PN}, c AS (SELECT p.id, p.sample_index AS chosen, n.sample_index AS rejected, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.tokens - n.tokens), p.sample_index, n.sample_index) AS rn FROM y p JOIN y n ON p.id = n.id AND p.ok AND NOT n.ok) SELECT id, chosen, rejected FROM c WHERE rn <= 3")
def j14_top_pairs(t: Tables) -> DataFrame:
    return _pairs(t, 3).select("id", "chosen", "rejected")


def _pairs(t: Tables, n: int) -> DataFrame:
    """Within a question of at most k candidates, so at most k * k / 4 pairs."""
    y = t.pool.join(t.gold.select("id", "gold"), "id").select("id", "sample_index", "tokens", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("ok"))
    p = y.where("ok").select("id", F.col("sample_index").alias("chosen"), F.col("tokens").alias("a"))
    q = y.where("not ok").select("id", F.col("sample_index").alias("rejected"), F.col("tokens").alias("b"))
    return X.top_n(p.join(q, "id"), ["id"], [F.abs(F.col("a") - F.col("b")), F.col("chosen"), F.col("rejected")], n)


@query("SELECT s AS pair, sum(hit)::BIGINT AS shared FROM (SELECT unnest(['tax_discount', 'tax_quantity', 'discount_quantity']) AS s, unnest([(l_tax > 0.04 AND l_discount > 0.05)::INT, (l_tax > 0.04 AND l_quantity > 25)::INT, (l_discount > 0.05 AND l_quantity > 25)::INT]) AS hit FROM lineitem) GROUP BY 1")
def j18_holdout_overlap(t: Tables) -> DataFrame:
    flags = {"tax": F.col("l_tax") > 0.04, "discount": F.col("l_discount") > 0.05, "quantity": F.col("l_quantity") > 25}
    names = [("tax", "discount"), ("tax", "quantity"), ("discount", "quantity")]
    sums = t.lineitem.agg(*(F.count_if(flags[a] & flags[b]).alias(f"{a}_{b}") for a, b in names))
    return sums.unpivot([], [f"{a}_{b}" for a, b in names], "pair", "shared")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 4000 UNION SELECT doc_id FROM labels) ORDER BY doc_id")
def u1_union_distinct(t: Tables) -> DataFrame:
    return t.documents.where("n_chars > 4000").select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def u4_intersect(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u5_u6_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


@query("SELECT doc_id, n_chars FROM documents")
def u7_shard_merge(t: Tables) -> DataFrame:
    """Shards apart, scored apart, merged under a check that they are disjoint and exhaustive."""
    d = X.shards(t.documents.select("doc_id", "n_chars"), "doc_id", 9, 2)
    return incremental.merge_shards([d.where(F.col("shard") == s).select("doc_id", "n_chars") for s in range(2)], t.documents.select("doc_id"), "doc_id")


@query("SELECT sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id || ':' || n_chars)) AS digest, count(*) AS n FROM documents")
def a33_rows_digest(t: Tables) -> DataFrame:
    lines = F.concat_ws(":", "doc_id", "n_chars")
    return t.documents.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "\n"), 256).alias("digest"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def a34_content_digests(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


@query("WITH a AS (SELECT doc_id, text FROM documents WHERE n_chars > 200) SELECT min(doc_id) AS doc_id FROM a GROUP BY text")
def streaming_first_accepted(t: Tables) -> DataFrame:
    return incremental.first_accepted(t.documents, F.col("n_chars") > 200, "text", "doc_id").select("doc_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def streaming_event_totals(t: Tables) -> DataFrame:
    return incremental.stream_totals(t.spark, f"{t.folder}/events.parquet")


@query(f"WITH {POOL}, y AS (SELECT id, sample_index, coalesce(answer = gold, false) AS ok, answer IS NULL AS bad, hit_max, row_number() OVER (PARTITION BY id, coalesce(answer = gold, false) ORDER BY tokens, sample_index) AS rn FROM pool JOIN gold USING (id)) SELECT CASE WHEN ok AND rn <= 2 THEN 'selected' WHEN bad THEN 'invalid' WHEN NOT ok THEN 'wrong' WHEN hit_max THEN 'truncated' ELSE 'over_cap' END AS reason, count(*) AS n FROM y GROUP BY 1")
def p16_rejection_reasons(t: Tables) -> DataFrame:
    y = t.pool.join(t.gold.select("id", "gold"), "id").withColumn("ok", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)))
    taken = X.top_n(y.where("ok"), ["id"], ["tokens", "sample_index"], 2).select("id", "sample_index", F.lit(True).alias("taken"))
    reason = F.when(F.col("taken"), "selected").when(F.col("answer").isNull(), "invalid").when(~F.col("ok"), "wrong").when(F.col("hit_max"), "truncated").otherwise("over_cap")
    return y.join(taken, ["id", "sample_index"], "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {POOL} SELECT id, sample_index FROM pool JOIN gold USING (id) WHERE id % 4 <> 0")
def p2_superset_tolerance(t: Tables) -> DataFrame:
    expected = t.gold.where("id % 4 <> 0").select("id")
    return t.pool.join(expected, "id", "left_semi").select("id", "sample_index")
