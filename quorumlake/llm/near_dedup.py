"""MinHash near-dedup by a signature-coordinate inverted join.

Each set of shingles has a signature: for each coordinate a minimum, and (coordinate, minimum) as one 64-bit token. Sets
are posted under their tokens. Two sets that share `matches` tokens share one among the first coordinates - matches + 1 of
each, in the order of the lists' lengths, so only these lists (the prefix) are merged: collisions are counted along them,
and the longer lists are skipped and only looked up for the pairs that the prefix brings. Pairs with `matches` collisions
are confirmed on the full sets.

Texts with equal sets are one posting, so copies never pair up. A list isn't paired off: its sets meet the list's most
central set first, and after that only sets of different components meet each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import components, flag_in, join_hot, maybe_in, mix, slices, small_batches, text_buffer, tidied, word_hashes, written

SHINGLE = 5
COORDINATES = 64
#: Of 64 coordinates a pair at the similarity of 0.85 shares 36 or more but for one pair in ten million.
MATCHES = 36
#: Lists up to this length are paired off between components; longer ones are compared in blocks.
SHORT_LIST = 64
#: Pairs of one set that meet its copy of signature or shingles in one task.
HUB_PAIRS = 500
#: Shingles that one task compares at a time; larger groups are dealt out as pairs of blocks.
BLOCK_SHINGLES = 400_000

_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct 64-bit hashes; fewer words make one shingle."""
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j] if len(rolled) else rolled
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            code = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    code = code * np.uint64(0x9E3779B97F4A7C15) + w
            out.append(mix(np.array([code])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of tokens for each set (none may be empty): each coordinate's minimum of a keyed hash, mixed with its number."""
    if not sets:
        return np.zeros((0, coordinates), np.uint64)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    low = np.empty((len(sets), coordinates), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(coordinates):
            x = (flat ^ _SEEDS[c]) * np.uint64(0xE7037ED1A0B428DB)
            low[:, c] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
        return mix(low * np.uint64(0x8EBC6AF09C88C6E3) + _SEEDS[:coordinates])


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that name the set."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, column: int, k: int):
    for piece in slices(batch, column):
        data, off = text_buffer(piece.column(column))
        yield piece, shingle_hashes(*word_hashes(data, off), k)


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(sets: list[np.ndarray], side: np.ndarray, roots: list[int], matches: int, percent: int, coordinates: int) -> list[tuple[int, int]]:
    """Links enough to join up all that are linked, given what roots join up already: a spanning forest of the pairs over
    the threshold.

    With both sides present (a pair of blocks) only pairs across are looked at. Candidates by signature are confirmed on
    the full sets, the likeliest first; a pair already joined up needs no look.
    """
    signed = signatures(sets, coordinates)
    first: dict[int, int] = {}
    parent, out = [first.setdefault(r, i) for i, r in enumerate(roots)], []
    across = bool(side.any()) and not side.all()
    for i in range(1, len(sets)):
        shared = (signed[:i] == signed[i]).sum(axis=1)
        near = np.flatnonzero(shared >= matches)
        if across:
            near = near[side[near] != side[i]]
        for j in near[np.argsort(-shared[near], kind="stable")].tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _beside(pairs: DataFrame, key: str, values: DataFrame, column: str, out: str, hub: int) -> DataFrame:
    """pairs with values' column of `key`. A key of many pairs (n of them at most) is dealt over n / hub tasks, each with
    a copy of its value."""
    salted = pairs.withColumn("_copies", F.ceil(F.col("n") / hub).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.col("_copies")).cast("int"))
    wanted = salted.select(key, "_copies", "_salt").distinct()
    copies = wanted.join(values.select(F.col("id").alias(key), F.col(column).alias(out)), key)
    return salted.join(copies, [key, "_copies", "_salt"]).drop("_copies", "_salt")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = 85,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    short_list: int = SHORT_LIST,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of other than \\x20 and \\x09-\\x0D, A-Z lower-cased; a text's set holds its distinct k-word shingles
    (all words as one when fewer). Texts are linked when 100 * intersection >= percent * union; component_id is the
    smallest id reachable, kept tells whether it is the row's own.

    Only links that join components are looked for, so neither copies nor groups of near copies give all their pairs.
    Lists longer than `short_list` that still hold several components are compared in blocks of bounded size, each task
    giving a spanning forest. Null and empty texts have no shingles and are linked with nothing. A null id is larger than
    any other: it is nobody's component_id unless all of the component are null. Repeated ids are separate rows; those
    with equal sets get equal results. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def sign(batches):
        for batch in batches:
            for piece, sets in _sets(batch, 1, k):
                full = [i for i, s in enumerate(sets) if len(s)]  # a text without shingles has no node
                tokens = dict(zip(full, signatures([sets[i] for i in full], coordinates), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), _list_column([tokens.get(i, s) for i, s in enumerate(sets)])],
                    names=["doc_id", "n_shingles", "node", "tokens"],
                )

    signed = written(rows.mapInArrow(tidied(sign), f"doc_id {id_type}, n_shingles long, node binary, tokens array<long>"))
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens"), F.count("*").alias("copies"))
    nodes = written(classes.withColumn("id", F.monotonically_increasing_id()))

    # Postings. A token of one set can't collide; a set with fewer than `matches` others has no partner.
    tokens = nodes.select("id", F.explode("tokens").alias("token"))
    lengths = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(lengths, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared"), F.sum("count").alias("weight")).where(F.size("shared") >= matches)  # `coordinates` entries at most
    prefix = F.explode(F.expr(f"slice(shared, 1, size(shared) - {matches} + 1)"))
    posts = written(shared.select("id", "weight", prefix.alias("p")).select("id", "weight", F.col("p.token").alias("token")))
    lists = posts.groupBy("token").agg(F.max(F.struct("weight", "id"))["id"].alias("lead"), F.count("*").alias("n")).where("n > 1")
    others = written(posts.join(lists, "token").where("id != lead").select("token", "id", "lead", "n"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (a, b, n) with `matches` collisions, linked on their full sets."""
        met = _beside(_beside(pairs, "a", nodes, "tokens", "_x", HUB_PAIRS), "b", nodes, "tokens", "_y", HUB_PAIRS)
        near = written(met.where(F.size(F.array_intersect("_x", "_y")) >= matches).select("a", "b", "n"))
        sets = written(full_sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        met = _beside(_beside(near, "a", sets, "shingles", "_x", HUB_PAIRS), "b", sets, "shingles", "_y", HUB_PAIRS)
        both = F.size(F.array_intersect("_x", "_y"))
        return met.where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(id, shingles) of the nodes wanted, from one text of each."""

        def resolve(batches):
            for batch in batches:
                for piece, sets in _sets(batch, 1, k):
                    keep = [i for i, s in enumerate(sets) if len(s)]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(keep, pa.int64())), pa.array([fingerprint(sets[i]) for i in keep], pa.binary()), _list_column([sets[i] for i in keep])], names=["low", "node", "shingles"])

        named = nodes.join(wanted, "id").select("id", "node", F.col("low").alias("_low"))
        places = written(named.withColumn("_key", F.xxhash64("_low")))
        candidates = maybe_in(rows.withColumn("_key", F.xxhash64("doc_id")), "_key", places).select("doc_id", "_text")
        found = candidates.mapInArrow(tidied(resolve), f"low {id_type}, node binary, shingles array<long>").join(places, "node").where("low <=> _low")
        return found.select("id", "shingles").dropDuplicates(["id"])

    star = others.groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    links = written(confirmed(star))

    # What is left: sets of a list, apart from its lead, that are in different components.
    roots = written(components(links))
    rest = others.select("token", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("token", "id", F.coalesce("root", "id").alias("root"))
    split = rest.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x != y").select("token", "n")
    rest = written(rest.join(split, "token"))
    short = rest.where(F.col("n") <= short_list)
    one, two = (short.select("token", F.col("id").alias(i), F.col("root").alias(r)) for i, r in (("a", "x"), ("b", "y")))
    pairs = one.join(two, "token").where("a < b and x != y").groupBy("a", "b").agg(F.lit(short_list).alias("n"))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(confirmed(pairs))

    long = written(rest.where(F.col("n") > short_list).select("token", "id"))
    found = written(components(links))
    if not long.isEmpty():
        across = _in_blocks(long, found, nodes, full_sets, matches, percent, coordinates, block_shingles)
        found = written(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across)))
    lows = found.join(nodes.select(F.col("id").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("node", "id", "low", "copies").join(found.select(F.col("node").alias("id"), "root"), "id", "left").join(lows, "root", "left")
    labels = written(named.select("node", F.coalesce("component_id", "low").alias("component_id"), "copies"))
    out = join_hot(signed.select("doc_id", "n_shingles", "node"), labels, "node", "copies", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _in_blocks(long: DataFrame, roots: DataFrame, nodes: DataFrame, full_sets, matches: int, percent: int, coordinates: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between the components of long lists (token, id).

    Lists that meet are one group; its blocks hold block_shingles on average, and each pair of blocks is a task of its
    own that returns a spanning forest."""
    firsts = long.groupBy("token").agg(F.min("id").alias("first"))
    groups = components(long.join(firsts, "token").select(F.col("id").alias("a"), F.col("first").alias("b")))
    members = nodes.join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id").select("id", "group", "n_shingles")
    members = written(members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    blocks = members.groupBy("group").agg(F.sum("n_shingles").alias("total")).select("group", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks"))
    dealt = members.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("id", "root", "group", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("id", "root", "group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") < F.col("other")).alias("side"))
    work = written(full_sets(members.select("id"))).join(dealt, "id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_pylist()
        lists = table.column("shingles").combine_chunks()
        flat, off = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        found = linked(sets, np.array(table.column("side").to_pylist(), bool), table.column("root").to_pylist(), matches, percent, coordinates)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return work.groupBy("group", "x", "y").applyInArrow(compare, "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component of near-duplicates: the one with the smallest id. All columns stay.

    Rows are told apart by id and text, so a repeated id with another text is a row of its own. Only rows that may have to
    go move; repeated rows that are equal in both stay or go together.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"))
    named = packed.select("_row", F.struct(F.col(f"_row.{id_col}").alias("id"), F.xxhash64(f"_row.{text_col}").alias("text")).alias("_id"), F.col(f"_row.{text_col}").alias("_words"))
    gone = written(near_dedup(named, "_id", "_words", **options).where("not kept").select(F.col("doc_id").alias("_id")).distinct())
    gone = gone.withColumn("_key", F.xxhash64("_id.id", "_id.text"))
    flagged = flag_in(named.withColumn("_key", F.xxhash64("_id.id", "_id.text")), "_key", gone)
    checked = flagged.where("_flag").join(gone.select(F.col("_id.id").alias("_a"), F.col("_id.text").alias("_b")), F.expr("_id.id <=> _a and _id.text = _b"), "left_anti")
    return flagged.where("not _flag").select("_row.*").unionByName(checked.select("_row.*"))
