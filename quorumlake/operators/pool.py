"""Candidate pools: one row a (id, sample_index), contract checks, prefixes, unions and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PATHS = ("final_answer_marker", "boxed", "standalone_last_line", "last_integer", "none")
WEAK_PATHS = ("standalone_last_line", "last_integer")


def pool_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The fixture's candidate pool: orders are questions, their line items generated candidates."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    path = F.element_at(F.array(*map(F.lit, PATHS[:4])), (F.round(F.col("l_discount") * 100) % 4 + 1).cast("int"))
    return lineitem.select(
        F.col("l_orderkey").alias("id"),
        (F.row_number().over(w) - 1).alias("sample_index"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), None).otherwise((F.floor("l_quantity") % 5).cast("string")).alias("answer"),
        path.alias("path"),
        (F.round(F.col("l_tax") * 100) == 8).alias("hit_max"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("tokens"),
        F.round(F.col("l_discount") * 10, 4).alias("score"),
        (F.col("l_suppkey") % 3).cast("int").alias("arm"),
        F.col("l_partkey").alias("trace"),
    )


def gold_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("string").alias("gold"), F.col("o_orderpriority").alias("segment"), F.col("o_custkey").alias("customer"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: empty when the key holds."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(rows: DataFrame, *keys: str) -> None:
    if not duplicate_keys(rows, *keys).isEmpty():
        raise ValueError(f"{keys} is not unique")


def coverage(pool: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per id of either side: whether it is missing or extra, and its number of samples below k."""
    have = pool.groupBy("id").agg(F.count_distinct(F.when(F.col("sample_index") < k, F.col("sample_index"))).alias("samples"))
    return expected.select("id").distinct().withColumn("_e", F.lit(True)).join(have.withColumn("_h", F.lit(True)), "id", "full_outer").select("id", F.col("_h").isNull().alias("missing"), F.col("_e").isNull().alias("extra"), F.coalesce("samples", F.lit(0)).alias("samples"))


def require_coverage(pool: DataFrame, expected: DataFrame, k: int) -> None:
    if not coverage(pool, expected, k).where(f"missing or extra or samples != {k}").isEmpty():
        raise ValueError(f"not every id has the samples 0..{k - 1}")


def prefix(pool: DataFrame, k: int) -> DataFrame:
    return pool.where(F.col("sample_index") < k)


def union_pools(pools: list[DataFrame], offset: int) -> DataFrame:
    """Pools one after another: pool i's sample indices move by i * offset."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("sample_index", F.col("sample_index") + i * offset)
        out = p if out is None else out.unionByName(p)
    return out


def splice(first: DataFrame, then: DataFrame, at: int) -> DataFrame:
    """Samples below `at` of one pool, the others of another."""
    return first.where(F.col("sample_index") < at).unionByName(then.where(F.col("sample_index") >= at))


def unanimous(pool: DataFrame, first: int) -> DataFrame:
    """Per id: whether its first samples are all there, valid and identical, which ends sampling."""
    head = pool.where(F.col("sample_index") < first)
    return head.groupBy("id").agg((F.count("*") == first).alias("_full"), F.count("answer").alias("_valid"), F.count_distinct("answer").alias("_kinds")).select("id", F.expr(f"_full and _valid = {first} and _kinds = 1").alias("stop"))


def low_quality_reasons(path: Column, hit_max: Column, conflict: Column) -> Column:
    """Why a vote is of low quality, as an array; empty when it is not."""
    return F.array_compact(
        F.array(
            F.when(path.isin(*WEAK_PATHS), F.lit("weak_extraction_path")),
            F.when(hit_max, F.lit("hit_max_new_tokens")),
            F.when(conflict, F.lit("conflicting_explicit_candidates")),
        )
    )


def scored(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """pool with the score of each (id, sample_index); a key that only one side has is an error."""
    keys = ["id", "sample_index"]
    both = pool.withColumn("_p", F.lit(True)).join(scores.withColumn("_s", F.lit(True)), keys, "full")
    checked = F.when(F.col("_p") & F.col("_s"), F.col("score")).otherwise(F.raise_error(F.lit("pool and scores differ in their keys")).cast("double"))
    return both.withColumn("score", checked).drop("_p", "_s")
