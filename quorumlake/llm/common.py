"""Shared parts of the corpus operators: scratch tables, bounded semi-join filters, components, word hashing."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG_MIN = -(2**63)


# ---------------------------------------------------------------- Spark side


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one under /tmp only where none is set (local tests)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/") + "/quorumlake"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, so a lost executor costs no recomputation.

    Unlike a cached or local copy it outlives the executors that made it.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't: `name`, with underscores after it as needed."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def make_room(df: DataFrame, names: list[str]) -> DataFrame:
    """df with every column that has one of the names, in any case, under an unused name; data and order stay."""
    for name in df.columns:
        if name.lower() in {n.lower() for n in names}:
            free = name + "_"
            while free.lower() in {c.lower() for c in [*df.columns, *names]}:
                free += "_"
            df = df.withColumnRenamed(name, free)
    return df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has the default of 10,000: texts make large rows, and a batch is
    held in the executor's and the worker's memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def flag_in(df: DataFrame, key: str, keys: DataFrame, flag: str = "_flag", words: int = 1 << 17) -> DataFrame:
    """df with `flag`: false only if `key` isn't among keys[key], true if it is, and now and then if it isn't.

    What is broadcast is a one-hash bitmap, bounded by `words` * 16 bytes at any input size; when the keys outgrow it,
    more rows are flagged and none is missed. `key` is a non-null long column in both.
    """
    slots = words * 64
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(slots)).alias("_b")).groupBy(F.expr("_b div 64").alias("_slot")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 as int)))").alias("_bits"))
    out = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(slots))).withColumn("_slot", F.expr("_b div 64")).join(F.broadcast(bits), "_slot", "left")
    return out.withColumn(flag, F.expr("coalesce((_bits & shiftleft(1L, cast(_b % 64 as int))) != 0, false)")).drop("_slot", "_b", "_bits")


def maybe_in(df: DataFrame, key: str, keys: DataFrame, words: int = 1 << 17) -> DataFrame:
    """Rows of df whose `key` may be among keys[key]: a semi-join reduction by flag_in; exact joins follow."""
    return flag_in(df, key, keys, "_flag", words).where("_flag").drop("_flag")


#: Keys whose rows don't move in join_hot: the most frequent ones, so what is broadcast has this many rows at most.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined to right (how: inner or left), which has one row a key and in `weight` the key's rows in left.

    Rows of the HOT_KEYS most frequent keys meet a broadcast of as many rows, all others are shuffled by key. A key with a
    third of all rows so stays where its rows are. left and right are read twice each.
    """
    flag = unused(left.join(right, key), "_hot")
    hot = F.broadcast(right.orderBy(F.desc(weight), key).limit(HOT_KEYS).drop(weight).withColumn(flag, F.lit(True)))
    met = left.join(hot, key, "left")
    rest = met.where(F.col(flag).isNull()).select(*left.columns).join(right.drop(weight), key, how)
    return met.where(F.col(flag)).drop(flag).unionByName(rest)


#: Edges that a task of components joins up at a time.
FOREST_EDGES = 200_000


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Edges that join up the same nodes: each node but the smallest of its component, with that smallest one."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    return nodes, [top(x) for x in nodes]


def components(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Connected components of (a, b), longs, as (node, root), root the smallest node. Nodes without an edge are absent.

    Tasks first join up what their own edges join, `forest_edges` at a time. What that leaves is dealt to as few tasks as
    take up to `forest_edges` each, which join it up once more; one task alone is done with that. Of several, large-star
    and small-star steps alternate until nothing changes, so fewer rounds are left the more of a component one task has
    seen. The steps are aggregations and joins; the rows of hubs meet a broadcast of bounded size, and nothing is
    collected. A round plans some ten jobs, which the driver's memory keeps traces of, however few the edges.
    """

    def joined(batches):
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= forest_edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a, b)], names=["a", "b"])

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def forests(links: DataFrame) -> DataFrame:
        return written(links.mapInArrow(tidied(joined), "a long, b long"))

    now = forests(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    tasks = max(1, math.ceil(now.count() / forest_edges))
    now = forests(now.repartition(tasks))
    before = state(now) if tasks > 1 else None
    while tasks > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = join_hot(both, low, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a != b")
        now = written(small.distinct())
        seen = state(now)
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --------------------------------------------------------------- Python side


def worker_cache(key: str, build):
    """One object for each Python worker process, built on first use; another key's object takes its place."""
    import pyspark

    held = pyspark.__dict__.setdefault("_quorumlake_cache", {})
    if key not in held:
        for other in [k for k in held if k != "powers" and key != "powers"]:
            del held[other]
        held[key] = build()
    return held[key]


def tidied(run):
    """A function of Arrow batches that leaves its worker's memory as small as it found it: workers outlive their tasks."""

    def wrapped(batches):
        import ctypes

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def release_memory() -> None:
    """Gives what this process no longer uses back to the system; for the driver, which outlives every fit."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column, without a copy of the text; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20):
    """The batch in pieces of at most `limit` text bytes (or one row), so that working memory doesn't follow batch size."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiply and shift), vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_codes(fold: bool) -> np.ndarray:
    """A random 64-bit code for each byte value; with fold, A-Z get the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n at least; kept in the worker."""
    held = worker_cache("powers", dict)
    if held.get("n", 0) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(BASE), -1, 2**64)
        with np.errstate(over="ignore"):
            held["p"] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]))
            held["q"] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, np.uint64(inverse), np.uint64)]))
        held["n"] = size
    return held["p"], held["q"]


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """cs with cs[j] - cs[i] = the polynomial hash of bytes i..j-1, times BASE**i."""
    p, _ = powers(len(data) + 1)
    cs = np.empty(len(data) + 1, np.uint64)
    cs[0] = 0
    np.cumsum(codes[data] * p[: len(data)], out=cs[1:])
    return cs


def span_hash(cs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(cs))
    return mix(((cs[end] - cs[start]) * q[start]) ^ ((end - start).astype(np.uint64) << np.uint64(40)))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20


#: Word shapes: five lengths in bytes, times whether the last byte is a sign, times whether the first is of a non-ASCII letter.
SHAPES = 20
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _shapes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (np.digitize(ends - starts, [4, 7, 10, 15]) * 4 + _SIGN[piece[ends - 1]] * 2 + (piece[starts] >= 128)).astype(np.int64)


def word_hashes(data: np.ndarray, off: np.ndarray, fold: bool = True, shapes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+) of consecutive texts, and each text's bounds among them.

    Texts are cut at white space into pieces of about a megabyte, so one very long text needs no more memory than many.
    With a list as `shapes`, an array of the words' shapes is appended to it.
    """
    codes = byte_codes(fold)
    hashes, forms, counts = [], [], np.zeros(len(off), np.int64)
    at, last = int(off[0]), int(off[-1])
    while at < last:
        stop = min(at + PIECE, last)
        if stop < last and not SPACE[data[stop - 1]]:
            doc_end = int(off[np.searchsorted(off, stop)])
            ahead = np.flatnonzero(SPACE[data[stop:doc_end]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else doc_end
        piece = data[at:stop]
        word = ~SPACE[piece]
        inner = off[(off > at) & (off < stop)] - at
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[inner] = word[inner]
        final = word.copy()
        final[:-1] &= ~word[1:]
        final[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
        hashes.append(span_hash(prefix_hash(piece, codes), starts, ends))
        if shapes is not None:
            forms.append(_shapes(piece, starts, ends))
        counts += np.bincount(np.searchsorted(off, starts + at, "right"), minlength=len(off))[: len(off)]
        at = stop
    bounds = np.concatenate([[0], np.cumsum(counts[1:])])
    if shapes is not None:
        shapes.append(np.concatenate(forms) if forms else np.zeros(0, np.int64))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), bounds
