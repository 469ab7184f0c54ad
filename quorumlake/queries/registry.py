"""The registry and the fixture's roles, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.operators.pool import gold_from_orders, pool_from_lineitem

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The candidate pool and its questions, as common table expressions.
POOL = """pool AS (SELECT l_orderkey AS id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS sample_index,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) % 5 AS VARCHAR) END AS answer,
  ['final_answer_marker', 'boxed', 'standalone_last_line', 'last_integer'][CAST(round(l_discount * 100) AS INT) % 4 + 1] AS path,
  round(l_tax * 100) = 8 AS hit_max, CAST(floor(l_extendedprice / 100) AS INT) AS tokens, round(l_discount * 10, 4) AS score,
  CAST(l_suppkey % 3 AS INT) AS arm, l_partkey AS trace FROM lineitem),
gold AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 AS VARCHAR) AS gold, o_orderpriority AS segment, o_custkey AS customer FROM orders)"""
GROUPS = "g AS (SELECT id, answer, count(*) AS n, min(sample_index) AS f FROM pool GROUP BY id, answer)"
MAJORITY = """maj AS (SELECT id, first(answer ORDER BY n DESC, f) FILTER (WHERE answer IS NOT NULL) AS answer, coalesce(sum(n) FILTER (WHERE answer IS NOT NULL), 0)::BIGINT AS valid,
  sum(n)::BIGINT AS total, coalesce(max(n) FILTER (WHERE answer IS NOT NULL), 0) AS top,
  coalesce((list(n ORDER BY n DESC) FILTER (WHERE answer IS NOT NULL))[2], 0) AS second FROM g GROUP BY id)"""
VOTES = f"WITH {POOL}, {GROUPS}, {MAJORITY}"


class Tables:
    """The tables of a folder, and the pool and questions derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def pool(self) -> DataFrame:
        return pool_from_lineitem(self.__getattr__("lineitem"))

    @property
    def gold(self) -> DataFrame:
        return gold_from_orders(self.__getattr__("orders"))


def query(sql: str | None = None):
    """Registers a function of Tables under its name, and the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
