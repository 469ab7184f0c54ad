"""Deterministic choices: hash order, caps, strata, holdouts, folds, shards, and the sequential ones by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlake.functions.text import stable_hash


def top_n(rows: DataFrame, by: list[str], order: list, n: Column | int) -> DataFrame:
    """The first n rows of each group in an order."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def winner(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The row of each group with the smallest order: an aggregation, so a large group is a row a task."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), order).alias("_row")).select(*by, "_row.*")


def evenly_spaced(rows: DataFrame, by: list[str], order: list, m: int) -> DataFrame:
    """m order statistics a group at round(i * (n - 1) / (m - 1)), half to even; all rows of smaller groups."""
    ranked = rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("_size") - 1) / max(m - 1, 1)).cast("long"))
    return ranked.join(sizes, by).where((F.col("_size") <= m) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_i", "_size")


def apportion(rows: DataFrame, stratum: str, key: str, fraction: float, seed: int) -> DataFrame:
    """A holdout of round(n * fraction) rows: whole parts by stratum, then largest remainders, ties in hash order.

    Strata are few, so their ranking is small; rows are ranked within their stratum.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    target = rows.agg(F.bround(F.count("*") * F.lit(fraction)).cast("long").alias("target"))
    exact = F.col("n") * F.lit(fraction)
    parts = sizes.withColumn("whole", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    given = parts.agg(F.sum("whole").alias("given")).crossJoin(target).select((F.col("target") - F.col("given")).alias("left"))
    ranked = parts.withColumn("_r", F.row_number().over(W.orderBy(F.desc("rest"), stable_hash(F.lit("stratum"), F.lit(seed), F.col(stratum)))))
    quota = ranked.crossJoin(F.broadcast(given)).select(stratum, (F.col("whole") + (F.col("_r") <= F.col("left")).cast("int")).alias("quota"))
    w = W.partitionBy(stratum).orderBy(stable_hash(F.lit("random"), F.lit(seed), F.col(stratum), F.col(key)))
    return rows.withColumn("_r", F.row_number().over(w)).join(quota, stratum).where("_r <= quota").drop("_r", "quota")


def running_holdout(groups: DataFrame, group: str, size: str, seed: int, target: int) -> DataFrame:
    """Groups in hash order until their sizes reach the target: each is taken whose predecessors sum to less."""
    w = W.orderBy(stable_hash(F.lit("template"), F.lit(seed), F.col(group))).rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < target).drop("_before")


def round_robin(rows: DataFrame, by: list[str], source: str, key: str, seed: int, n: int) -> DataFrame:
    """n rows a group, one source after another in hash order."""
    own = W.partitionBy(*by, source).orderBy(stable_hash(F.lit(seed), F.col(key)), key)
    order = W.partitionBy(*by).orderBy("_round", stable_hash(F.lit(seed), F.col(source)), source)
    return rows.withColumn("_round", F.row_number().over(own)).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_round", "_place")


#: Rows that are ranked in one task by `ranked`, about.
RANGE_ROWS = 200_000


def ranked(rows: DataFrame, keys: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their place from 0 on in the order of keys, whose first is a number: ranks within ranges of it, moved by
    what the ranges before hold. The number of ranges follows the rows."""
    from quorumlake.operators.metrics import _ranges

    cuts = max(2, -(-rows.count() // range_rows))
    dealt = _ranges(rows, keys[0], cuts)
    within = dealt.withColumn(out, F.row_number().over(W.partitionBy("_range").orderBy(*keys)) - 1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return within.join(before, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def hash_order(rows: DataFrame, key: str, namespace: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with their position in the order of (sha256 of namespace, seed and key; key), whole or within groups.

    Rows are ranked within the 4,096 ranges of the hash's first three digits, which all hold alike many, and moved by what
    the ranges before hold: no task sees more than a range.
    """
    hashed = rows.withColumn("_h", stable_hash(F.lit(namespace), F.lit(seed), F.col(key))).withColumn("_range", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    own = F.row_number().over(W.partitionBy(*by, "_range").orderBy("_h", key))
    ranked = hashed.withColumn("_own", own).join(offsets, [*by, "_range"])
    return ranked.withColumn("position", F.col("_own") - 1 + F.col("_offset")).select(*rows.columns, "position")


def shards(rows: DataFrame, key: str, seed: int, ways: int) -> DataFrame:
    """Keys dealt round-robin in hash order."""
    return hash_order(rows, key, "shard", seed).withColumn("shard", (F.col("position") % ways).cast("int"))


def cyclic_epochs(rows: DataFrame, key: str, seed: int, ranks: int) -> DataFrame:
    """(rank, step, key): hash order padded from its start to a multiple of ranks, dealt round-robin."""
    ordered = hash_order(rows.select(key), key, "epoch", seed)
    n = ordered.agg(F.count("*").alias("n"))
    with_n = ordered.crossJoin(F.broadcast(n))
    padding = with_n.where(F.col("position") < F.pmod(-F.col("n"), F.lit(ranks))).withColumn("position", F.col("position") + F.col("n"))
    return with_n.unionByName(padding).select(key, (F.col("position") % ranks).cast("int").alias("rank"), F.floor(F.col("position") / ranks).alias("step"))


def budget_matched(groups: DataFrame, key: str, budget: int, seed: int) -> DataFrame:
    """Equal shares of a budget, the remainder one each in hash order."""
    n = groups.agg(F.count("*").alias("n"))
    return hash_order(groups.select(key), key, "budget", seed).crossJoin(F.broadcast(n)).select(key, (F.floor(F.lit(budget) / F.col("n")) + (F.col("position") < F.lit(budget) % F.col("n")).cast("int")).alias("share"))


def sequential_quotas(rows: DataFrame, key: str, categories: list[tuple[str, Column, int]], seed: int) -> DataFrame:
    """Categories in turn take up to their quota in hash order from what earlier ones left. One step a category."""
    left, out = rows, None
    for name, test, quota in categories:
        got = left.where(test).orderBy(stable_hash(F.lit(name), F.lit(seed), F.col(key)), key).limit(quota).select(key, F.lit(name).alias("category"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    return out


def lpt_folds(groups: DataFrame, group: str, size: str, folds: int) -> DataFrame:
    """Groups from the largest on, each to the fold with the least so far.

    The order is inherent, so group sizes (one row a group) pass one task; rows of the groups never do.
    """
    import pandas as pd

    kind = groups.schema[group].dataType.simpleString()

    def assign(sizes: pd.DataFrame) -> pd.DataFrame:
        import heapq

        heap = [(0, f) for f in range(folds)]
        out = []
        for g, n in sizes.sort_values([size, group], ascending=[False, True])[[group, size]].itertuples(index=False):
            total, fold = heapq.heappop(heap)
            out.append((g, fold))
            heapq.heappush(heap, (total + n, fold))
        return pd.DataFrame(out, columns=[group, "fold"])

    return groups.select(group, size).groupBy(F.lit(0).alias("_all")).applyInPandas(assign, f"`{group}` {kind}, fold int")


def greedy_pairs(rows: DataFrame, by: list[str], key: str, label: str, value: str) -> DataFrame:
    """(by, positive, negative): within a group each positive in key order takes the nearest unused negative."""
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        free = group[group[label] == 0].sort_values(key)[[key, value]].values.tolist()
        out = []
        for k, v in group[group[label] == 1].sort_values(key)[[key, value]].values.tolist():
            if free:
                best = min(range(len(free)), key=lambda i: (abs(free[i][1] - v), free[i][0]))
                out.append((*(group[b].iloc[0] for b in by), k, free.pop(best)[0]))
        return pd.DataFrame(out, columns=[*by, "positive", "negative"])

    return rows.select(*by, key, label, value).groupBy(*by).applyInPandas(match, f"{fields}, positive {kind}, negative {kind}")


def quantile_picks(rows: DataFrame, by: list[str], key: str, value: str, quantiles: list[float]) -> DataFrame:
    """For each quantile in turn, the unused row of a group nearest to it."""
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        free = group.sort_values(key)[[key, value]].values.tolist()
        out = []
        for q in quantiles:
            if free:
                goal = group[value].quantile(q)
                best = min(range(len(free)), key=lambda i: (abs(free[i][1] - goal), free[i][0]))
                out.append((*(group[b].iloc[0] for b in by), q, free.pop(best)[0]))
        return pd.DataFrame(out, columns=[*by, "quantile", key])

    return rows.select(*by, key, value).groupBy(*by).applyInPandas(pick, f"{fields}, quantile double, `{key}` {kind}")


def pack(rows: DataFrame, by: list[str], key: str, size: str, capacity: int) -> DataFrame:
    """(by, key, bin): best-fit decreasing of sizes into bins of the capacity, within each group (a shard)."""
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        room: list[tuple[int, int]] = []
        out, bins = [], 0
        for k, n in group.sort_values([size, key], ascending=[False, True])[[key, size]].itertuples(index=False):
            n = min(int(n), capacity)
            at = bisect_left(room, (n, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b, bins = capacity, bins, bins + 1
            insort(room, (left - n, b))
            out.append((*(group[c].iloc[0] for c in by), k, b))
        return pd.DataFrame(out, columns=[*by, key, "bin"])

    return rows.select(*by, key, size).groupBy(*by).applyInPandas(fit, f"{fields}, `{key}` {kind}, bin int")


def token_batches(rows: DataFrame, by: list[str], key: str, tokens: str, budget: int) -> DataFrame:
    """(by, key, batch): rows by length, a batch closed before count * longest would pass the budget."""
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        out, batch, count = [], 0, 0
        for k, n in group.sort_values([tokens, key])[[key, tokens]].itertuples(index=False):
            if count and (count + 1) * n > budget:
                batch, count = batch + 1, 0
            count += 1
            out.append((*(group[c].iloc[0] for c in by), k, batch))
        return pd.DataFrame(out, columns=[*by, key, "batch"])

    return rows.select(*by, key, tokens).groupBy(*by).applyInPandas(cut, f"{fields}, `{key}` {kind}, batch int")
