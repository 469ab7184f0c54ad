"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import slices, small_batches, text_buffer, tidied, unused, worker_cache, written

WINDOW = 10
#: Characters of normalised windows that one automaton may hold; more are split over several scans.
AUTOMATON_CHARS = 24_000_000

# A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; all else parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The windows of one item: every run of `size` consecutive words, or all words when there are fewer."""
    words = normal_words((text or "").encode())
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def build_automaton(items: list[tuple[object, str]], size: int = WINDOW):
    import ahocorasick

    owners: dict[bytes, list[int]] = {}
    for number, (_, text) in enumerate(items):
        for window in item_windows(text, size):
            held = owners.setdefault(window, [])
            if not held or held[-1] != number:
                held.append(number)
    automaton = ahocorasick.Automaton()
    for window, numbers in owners.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (len(window), tuple(numbers)))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def scan_text(raw: bytes, automaton) -> tuple[int, list[int], list[int], list[int], set[int]]:
    """n_words, then byte offsets in the original of hit words' starts and ends, the hit words' numbers, and item numbers.

    Folding maps bytes one to one, so a word's place in the folded text is its place in the original.
    """
    folded = raw.translate(_FOLD)
    words = folded.split()
    if automaton is None or not words:
        return len(words), [], [], [], set()
    found, spans = set(), []
    for end, (length, numbers) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
        spans.append((end - length - 1, end - 1))  # places in the joined words
        found.update(numbers)
    if not spans:
        return len(words), [], [], [], found
    places = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    hit = np.zeros(len(words) + 1, np.int64)
    start, end = np.array(spans).T
    np.add.at(hit, np.searchsorted(places, start), 1)
    np.add.at(hit, np.searchsorted(places, end + 1), -1)
    numbers = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    letters = np.concatenate([[False], np.frombuffer(folded, np.uint8) != 32, [False]])
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    return len(words), edges[::2][numbers].tolist(), edges[1::2][numbers].tolist(), numbers.tolist(), found


def _shards(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> list[list[tuple[object, str]]]:
    """Items in shards whose windows fit an automaton of bounded size. The benchmark is the protected set, read in parts."""
    shards, used = [[]], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        need = len(row[1].encode()) * size
        if shards[-1] and used + need > limit:
            shards.append([])
            used = 0
        shards[-1].append((row[0], row[1]))
        used += need
    return shards


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """Per input row: doc_id, n_words, hit_words (numbers of hit words), hit_starts and hit_ends (byte offsets of each
    in the original UTF-8 text) and items (ids of the items with a window in the text, as sorted strings).

    The automaton's size is bounded by `limit`; a larger benchmark is split into shards of items, each with its own scan,
    whose findings are united per row. Null and empty texts have no words; null items or item ids are ignored; repeated
    items or ids count once; an empty benchmark contaminates nothing. Repeated document rows give repeated results.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shards = _shards(benchmark, item_col, item_text_col, window, limit)
    schema = "doc_id {}, n_words long, hit_words array<int>, hit_starts array<int>, hit_ends array<int>, items array<string>"

    def scanner(items, key):
        def scan(batches):
            automaton = worker_cache(key, lambda: build_automaton(items, window))
            for batch in (piece for whole in batches for piece in slices(whole, 1)):
                data, off = text_buffer(batch.column(1))
                raw, rows = data[off[0] : off[-1]].tobytes(), []
                off = off - off[0]
                for i in range(len(off) - 1):
                    n, starts, ends, words, found = scan_text(raw[off[i] : off[i + 1]], automaton)
                    rows.append((n, words, starts, ends, sorted({str(items[k][0]) for k in found})))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in columns[1:4]), pa.array(columns[4], pa.list_(pa.string())), *batch.columns[2:]],
                    names=["doc_id", "n_words", "hit_words", "hit_starts", "hit_ends", "items", *batch.schema.names[2:]],
                )

        return scan

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    key = lambda items: "ac:" + hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if len(shards) == 1:
        return rows.mapInArrow(tidied(scanner(shards[0], key(shards[0]))), schema.format(kind))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = [rows.mapInArrow(tidied(scanner(s, key(s))), schema.format(kind) + ", _row long") for s in shards]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    merged = united.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("hit_words", "hit_starts", "hit_ends"))))).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", F.col("_hits.hit_words").alias("hit_words"), F.col("_hits.hit_starts").alias("hit_starts"), F.col("_hits.hit_ends").alias("hit_ends"), "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_contamination's findings in digest form: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """docs without the rows whose text holds a window of a benchmark item; columns stay as they are. One scan a shard."""
    small_batches(docs.sparkSession)
    for items in _shards(benchmark, item_col, item_text_col, window, limit):
        key = "ac:" + hashlib.sha256(repr((window, items)).encode()).hexdigest()

        def clean(batches, items=items, key=key):
            automaton = worker_cache(key, lambda: build_automaton(items, window))
            for batch in (piece for whole in batches for piece in slices(whole, whole.num_columns - 1)):
                data, off = text_buffer(batch.column(batch.num_columns - 1))
                raw = data[off[0] : off[-1]].tobytes()
                off = off - off[0]
                mask = [not scan_text(raw[off[i] : off[i + 1]], automaton)[4] for i in range(len(off) - 1)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(mask, pa.bool_()))

        docs = docs.withColumn(unused(docs, "_scanned"), F.col(text_col)).mapInArrow(tidied(clean), docs.schema)
    return docs
