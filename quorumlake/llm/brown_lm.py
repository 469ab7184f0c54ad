"""Brown class-based bigram model: exchange clustering of words into classes, class transitions, word emissions.

log10 P(text) sums, over its words and one end, log10 P(class | class before) + log10 P(word | class). Every word whose
count reaches both MIN_COUNT and the share FREQUENCY of all tokens is clustered by exchange, so there are 1 / FREQUENCY of
them at most in a corpus of any size; rarer words belong to a class by their shape. All counts cover the whole training
corpus. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import SHAPES, slices, small_batches, text_buffer, tidied, word_hashes, written

#: A word is clustered from this count on, and from this share of all tokens on.
MIN_COUNT, FREQUENCY = 8, 1e-6
#: Sweeps of the exchange, at most; it ends before when no word moves.
SWEEPS = 3
#: Words that one task moves one after another; tasks don't see each other's moves of the same sweep.
SHARD_WORDS = 2048
#: Smoothing of emissions (added to each count) and of transitions (weight of the class's own share).
ALPHA, BETA = 0.5, 5.0
END = np.int64(0x454E44)
#: Symbols of a run whose neighbours are counted at a time.
RUN_STEP = 1 << 18
#: Runs in an Arrow batch; a run is of some two megabytes of text.
RUN_BATCH = 1


def class_number(words: int) -> int:
    """Twice the cube root of the number of clustered words: 2 to 200."""
    return max(1, min(words, round(2 * words ** (1 / 3))))


def _words(batch: pa.RecordBatch, column: int):
    for piece in slices(batch, column):
        data, off = text_buffer(piece.column(column))
        shapes: list = []
        hashes, bounds = word_hashes(data, off, shapes=shapes)
        yield piece, hashes.view(np.int64), shapes[0], bounds


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys with summed counts, and the least of what else belongs to a key. Empties parts, to hold keys once."""
    keys, counts, *rest = (np.concatenate(p) for p in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys)
    for column in (keys, counts, *rest):
        column[:] = column[order]
    del order
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    keys = keys[first]
    return keys, np.add.reduceat(counts, first, dtype=np.int64), *(np.minimum.reduceat(x, first) for x in rest)


def _summed(parts, limit: int = 1_000_000, rows: int = 1 << 16):
    """parts added up, given out whenever the keys gathered so far are many, by so many rows: a batch of all of them would be
    held by the worker and by the executor's JVM at once. What isn't added up here is by the aggregation that follows."""
    held, size = [], 0
    for part in itertools.chain(parts, [None]):
        if part is not None:
            held.append(part)
            size += len(part[0])
        if size > limit or part is None and held:
            columns, size = _added(held), 0
            for at in range(0, len(columns[0]), rows):
                yield tuple(x[at : at + rows] for x in columns)
            del columns


def count_words(docs: DataFrame) -> DataFrame:
    """h, c, shape of all words and the end in `_text`; tasks count their own words first."""

    def parts(batches):
        for batch in batches:
            if batch.num_rows:
                yield np.array([END]), np.array([batch.num_rows], np.int32), np.array([0], np.int32)
            for _, hashes, shapes, _ in _words(batch, 0):
                found, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                yield found, counts.astype(np.int32), shapes[first].astype(np.int32)

    def run(batches):
        for keys, counts, shapes in _summed(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(shapes)], names=["h", "c", "shape"])

    return docs.select("_text").mapInArrow(tidied(run), "h long, c long, shape int").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))


def _symbols(hashes: np.ndarray, shapes: np.ndarray, bounds: np.ndarray, head: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol of each token (ends included, one after each text), each token's text, and the places of the words.

    Symbols: 0 the end, then the shapes, then the clustered words by rank. head holds the words' sorted hashes.
    """
    word = 1 + shapes
    if len(head) and len(hashes):
        at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
        word = np.where(head[at] == hashes, 1 + SHAPES + ranks[at], word)
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    places = np.arange(len(hashes)) + owner
    symbols = np.zeros(len(hashes) + texts, np.int64)
    symbols[places] = word
    return symbols, np.repeat(np.arange(texts), np.diff(bounds) + 1), places


def symbol_runs(docs: DataFrame, head: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """The texts of docs (column _text) as runs of symbols, packed as 32-bit integers; a run holds whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast({"head": head, "ranks": ranks})

    def run(batches):
        for batch in batches:
            for _, hashes, shapes, bounds in _words(batch, 0):
                symbols, _, _ = _symbols(hashes, shapes, bounds, **shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([symbols.astype(np.int32).tobytes()], pa.binary())], names=["run"])

    return docs.select("_text").mapInArrow(tidied(run), "run binary")


def count_neighbours(runs: DataFrame, of: np.ndarray, total: int, step: int = RUN_STEP) -> DataFrame:
    """(s, at, n) of a clustering `of` symbols into `total` classes, over all neighbours; each text starts after an end.

    Of a clustered word s: how often class `at` follows it, class at - total is before it, and (at = 2 * total) it follows
    itself. Of class k, as s = -1 - k: how often class `at` follows. Tasks add up their own counts first, `step` symbols of a
    run at a time.
    """
    shared = runs.sparkSession.sparkContext.broadcast(of)
    width = 2 * total + 1

    def parts(batches):
        classes, first = shared.value, 1 + SHAPES
        for batch in batches:
            for raw in batch.column(0):
                symbols = np.frombuffer(raw.as_buffer(), np.int32)
                for at in range(0, len(symbols), step):
                    after = symbols[at : at + step].astype(np.int64)
                    before = np.concatenate([symbols[at - 1 : at] if at else [0], after[:-1]]).astype(np.int64)
                    kinds, kinds_before = classes[after], classes[before]
                    lead, follow, twice = before >= first, after >= first, (after == before) & (after >= first)
                    keys = np.concatenate([before[lead] * width + kinds[lead], after[follow] * width + total + kinds_before[follow], after[twice] * width + 2 * total, (-1 - kinds_before) * width + kinds])
                    found, counts = np.unique(keys, return_counts=True)
                    yield found, counts.astype(np.int32)

    def run(batches):
        for keys, counts in _summed(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(counts)], names=["s", "at", "n"])

    return runs.mapInArrow(tidied(run), "s int, at int, n long").groupBy("s", "at").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def move_words(words: list[tuple[int, np.ndarray, np.ndarray]], of: np.ndarray, m: np.ndarray, classes: int) -> list[tuple[int, int]]:
    """The class of each word (s, at, n) after each in turn moved to the class, of 1 to `classes`, where the likelihood of
    the class bigrams m is largest. `of` and m are changed by the moves."""
    total, out = len(m), []
    rows, cols, diagonal = m.sum(axis=1), m.sum(axis=0), np.diag(m)
    told, movable = _f(m), slice(1, 1 + classes)  # told is kept equal to _f(m)
    for s, at, n in words:
        own = int(of[s])
        counts = np.zeros(2 * total + 1)
        counts[at] = n
        right, left, loop = counts[:total], counts[total:-1], counts[-1]
        right[own] -= loop
        left[own] -= loop
        gone, came = right.sum() + loop, left.sum() + loop
        after, before = np.flatnonzero(right), np.flatnonzero(left)
        m[own] -= right
        m[:, own] -= left
        m[own, own] -= loop
        told[own], told[:, own] = _f(m[own]), _f(m[:, own])
        # the sums of a class's row and column but for the word's own part
        rows[own] -= gone
        cols[own] -= came
        rows -= left
        cols -= right
        by_row = _f(m[:, after] + right[after]) - told[:, after]
        by_col = _f(m[before] + left[before, None]) - told[before]
        gain = by_row.sum(axis=1) + by_col.sum(axis=0)
        # where row and column meet, both parts and the loops come together
        both = diagonal + right + left
        gain += _f(both + loop) - _f(diagonal + right) - _f(diagonal + left) + np.diag(told)
        sums = np.concatenate([rows + left, cols + right])
        sums = _f(sums + np.repeat((gone, came), total)) - _f(sums)
        gain -= sums[:total] + sums[total:]
        best = 1 + int(np.argmax(gain[movable]))
        if gain[best] <= gain[own] + 1e-9:
            best = own
        m[best] += right
        m[:, best] += left
        m[best, best] += loop
        told[best], told[:, best] = _f(m[best]), _f(m[:, best])
        rows += left
        cols += right
        rows[best] += gone
        cols[best] += came
        of[s] = best
        out.append((s, best))
    return out


def sweep(counts: DataFrame, of: np.ndarray, m: np.ndarray, classes: int, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, int]:
    """The classes after one exchange of every clustered word, and how many moved. Shards of words move side by side, each
    against the same class bigrams; a shard holds `shard_words` words on average and doesn't depend on the cluster."""
    shards = max(1, -(-(len(of) - 1 - SHAPES) // shard_words))
    shared = counts.sparkSession.sparkContext.broadcast({"of": of, "m": m})

    def run(batches):
        def solve(table: pa.Table):
            s, at, n = (table.column(c).to_numpy() for c in ("s", "at", "n"))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]).tolist()
            words = [(int(s[a]), at[a:b], n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            moved = move_words(words, shared.value["of"].copy(), shared.value["m"].copy(), classes)
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in moved], pa.int32()), pa.array([c for _, c in moved], pa.int32())], names=["s", "class"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            edges = np.flatnonzero(np.diff(held.column("shard").to_numpy())) + 1
            start = 0
            for edge in edges.tolist():  # the last shard may go on in the next batch
                yield solve(held.slice(start, edge - start))
                start = edge
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = counts.where("s >= 0").withColumn("shard", F.col("s") % shards).repartition(shards, "shard").sortWithinPartitions("shard", "s", "at")
    moved = dealt.mapInArrow(tidied(run), "s int, class int").toArrow()
    out = of.copy()
    out[moved.column("s").to_numpy()] = moved.column("class").to_numpy()
    return out, int((out != of).sum())


def _class_bigrams(counts: DataFrame, total: int) -> np.ndarray:
    m = np.zeros((total, total))
    found = counts.where("s < 0").toArrow()
    m[-1 - found.column("s").to_numpy(), found.column("at").to_numpy()] = found.column("n").to_numpy()
    return m


def likelihood(m: np.ndarray) -> float:
    """What of the training texts' log likelihood depends on the clustering."""
    return float(_f(m).sum() - _f(m.sum(axis=1)).sum() - _f(m.sum(axis=0)).sum())


def _written_by_runs(df: DataFrame) -> DataFrame:
    """df, made of runs, written with RUN_BATCH runs an Arrow batch: runs are large, and a batch of all of a task's would be held
    by the executor's JVM and the worker at once. The session's own setting is put back."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, str(RUN_BATCH))
    try:
        return written(df)
    finally:
        conf.set(key, before)


def cluster(runs: DataFrame, words: int, classes: int, sweeps: int = SWEEPS, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each symbol (0 the end, then the exchange classes, then the shapes) and the class bigrams.

    Each sweep counts the neighbours' classes over all texts anew. The clustering with the largest likelihood stays."""
    total = 1 + classes + SHAPES
    of = np.concatenate([[0], 1 + classes + np.arange(SHAPES), 1 + np.arange(words) % max(classes, 1)]).astype(np.int64)
    best = None
    for number in range(sweeps + 1):
        counts = _written_by_runs(count_neighbours(runs, of, total))
        m = _class_bigrams(counts, total)
        if best is None or likelihood(m) > best[0]:
            best = (likelihood(m), of, m)
        elif number:  # side by side, the last moves made it worse
            break
        if number == sweeps or not words:
            break
        of, moved = sweep(counts, of, m.copy(), classes, shard_words)
        if not moved:
            break
    return best[1], best[2]


def train(docs: DataFrame, counts: DataFrame, min_count: int = MIN_COUNT, frequency: float = FREQUENCY, classes: int | None = None, sweeps: int = SWEEPS, shard_words: int = SHARD_WORDS) -> dict:
    """What every task needs to score, fitted on all texts of docs (column _text), given their word counts: the clustered
    words' sorted hashes, their counts and ranks, the symbols' classes, log10 tables and totals.

    What comes to the driver is a row a clustered word (1 / frequency of them at most) and the class bigrams."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == int(END), F.col("c"))), F.lit(0))).first()
    bound = max(min_count, math.ceil(int(totals[0]) * frequency))
    words = counts.where(F.col("h") != int(END))
    top = words.where(F.col("c") >= bound).select("h", "c").toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    hashes, values = (top.column(c).to_numpy() for c in ("h", "c"))
    ranks = np.argsort(hashes)
    head = hashes[ranks]
    k = class_number(len(hashes)) if classes is None else min(classes, len(hashes))
    of, m = cluster(written(symbol_runs(docs, head, ranks)), len(hashes), k, sweeps, shard_words)
    total = len(m)
    share = (m.sum(axis=0) + 1) / (m.sum() + total)
    transitions = np.log10((m + BETA * share) / (m.sum(axis=1, keepdims=True) + BETA))
    # distinct words and tokens of each class
    kinds = of[1 + SHAPES :]
    distinct = np.bincount(kinds, minlength=total).astype(float)
    mass = np.bincount(kinds, weights=values, minlength=total)
    for r in words.where(F.col("c") < bound).groupBy("shape").agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect():
        distinct[1 + k + r["shape"]] += r["v"]
        mass[1 + k + r["shape"]] += r["c"]
    return {
        "head": head, "head_counts": values[ranks], "ranks": ranks, "classes": of, "transitions": transitions,
        "emission_totals": np.log10(mass + ALPHA * (distinct + 1)), "tokens": int(totals[0]), "words": int(totals[1]), "ends": int(totals[2]),
    }


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, **options) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from rows that aren't held out (by default those whose crc32 of the id as text leaves 2 by 7 are; a null id is
    not). base_score is the add-one unigram's log10 probability, score the class model's; perplexity is that of score a
    token. Null and empty texts are one end. Without training rows every word is unknown. Repeated rows count each.

    options are those of train. Corpus counts are summed in the tasks before they are shuffled. The clustered words go to
    the tasks (24 bytes each, 1 / frequency of them at most); other words of a text meet their counts in a join whose keys
    are all rare: each has less than that share of all tokens, or less than min_count of them. One very long text is
    handled whole, a megabyte at a time. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rule = held_out if held_out is not None else F.crc32(F.col(id_col).cast("string")) % 7 == 2
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(rule, F.lit(False)).alias("held_out"), F.col(text_col).alias("_text"))
    training = rows.where(~F.col("held_out"))
    counts = written(count_words(training))
    model = train(training, counts, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = np.log10(model["tokens"] + model["words"] + 1)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        m = shared.value
        for batch in batches:
            for piece, hashes, shapes, bounds in _words(batch, 2):
                n = len(bounds) - 1
                symbols, owner, places = _symbols(hashes, shapes, bounds, m["head"], m["ranks"])
                kinds = m["classes"][symbols]
                before = np.concatenate([[0], kinds[:-1]])
                total = _sums(m["transitions"][before, kinds], owner, n)
                word_owner, word_kinds = owner[places], kinds[places]
                total -= _sums(m["emission_totals"][word_kinds], word_owner, n)
                if len(m["head"]):
                    at = np.minimum(np.searchsorted(m["head"], hashes), len(m["head"]) - 1)
                    in_head = m["head"][at] == hashes
                else:
                    at, in_head = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                seen, seen_owner = m["head_counts"][at[in_head]] if len(m["head"]) else np.zeros(0, np.int64), word_owner[in_head]
                total += _sums(np.log10(seen + ALPHA), seen_owner, n)
                tokens = np.diff(bounds) + 1
                base = _sums(np.log10(seen + 1), seen_owner, n) + np.log10(m["ends"] + 1) - tokens * rest
                known = np.bincount(seen_owner, minlength=n) + int(m["ends"] > 0)
                left = hashes[~in_head]
                off = np.concatenate([[0], np.cumsum(np.bincount(word_owner[~in_head], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.ListArray.from_arrays(pa.array(off), pa.array(left))],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "total", "rare"],
                )

    part = written(rows.mapInArrow(tidied(score), f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, total double, rare array<long>").withColumn("_row", F.monotonically_increasing_id()))
    rare = part.select("_row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = rare.groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1)).alias("_base"), F.sum(F.log10(F.col("c") + ALPHA)).alias("_total"), F.count_if(F.col("c") > 0).alias("_known"))
    out = part.drop("rare").join(more, "_row", "left")
    zero = F.lit(0.0)
    scored = F.col("total") + F.coalesce("_total", zero)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"),
        scored.alias("score"),
        F.pow(F.lit(10.0), -scored / F.col("n_tokens")).alias("perplexity"),
    )
