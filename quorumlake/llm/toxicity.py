"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import release_memory, slices, small_batches, tidied, unused, worker_cache, written

#: Rows that the lexicon is fitted on, at most: labelled training rows in hash order.
FIT_ROWS = 6_000
THRESHOLD = 0.7

# Look-alike letters (Cyrillic, Greek, full width) and digit or sign substitutions, each as the letter it
# stands for. i, l, 1, ! and | become one letter, as any may stand for another.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
_TABLE = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()}
_TABLE |= {0xFF41 + i: chr(97 + i) if i != 11 else "i" for i in range(26)}
_TABLE |= {ord(c): None for c in "­​‌‍⁠﻿"}
_TABLE |= {ord(k): v for k, v in _LOOKALIKES.items()}


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutions undone, ASCII punctuation as blanks, one blank at either end."""
    return f" {text.lower().translate(_TABLE)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries begin with a blank (a word's start); those that also end with one are whole words."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights:
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found


def features(text: str, automaton) -> tuple[float, float]:
    """log(1 + weight) of the matches, and their weight per square root of the words; exceptions cover their matches."""
    if not len(automaton):
        return 0.0, 0.0
    folded = fold(text)
    hits, covered = [], []
    for end, (length, weight) in automaton.iter(folded):
        (hits if weight else covered).append((end + 1 - length, end + 1, weight))
    if covered:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in covered)]
    if not hits:
        return 0.0, 0.0
    best: dict[int, float] = {}
    for start, _, weight in hits:  # one match for each word, the weightiest
        best[start] = max(weight, best.get(start, 0.0))
    total = sum(best.values())
    return math.log1p(total), total / math.sqrt(1 + folded.count(" "))


def probability(x: tuple[float, float], coefficients: tuple[float, float, float]) -> float:
    z = coefficients[0] + coefficients[1] * x[0] + coefficients[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _prefixes(word: str) -> list[str]:
    return [" " + word[:k] for k in range(3, min(len(word), 8) + 1)] + [f" {word} "]


def _distinct(docs: list[tuple[frozenset, int]], coordinates: int = 16, alike: int = 10) -> list[tuple[frozenset, int]]:
    """One text of each set of near copies (by 16 min-hashes of its words), as copies would count their words many times."""
    salts = [zlib.crc32(b"%d" % k) for k in range(coordinates)]
    groups: dict[tuple[int, int], list[int]] = {}
    kept, signatures = [], []
    for words, label in docs:
        codes = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        signature = [int((((codes ^ np.uint64(s)) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min()) for s in salts] if len(codes) else [0] * coordinates
        shared = Counter(i for k in range(coordinates) for i in groups.get((k, signature[k]), ()))
        if any(n >= alike for n in shared.values()):
            continue
        for k in range(coordinates):
            groups.setdefault((k, signature[k]), []).append(len(kept))
        kept.append((words, label))
        signatures.append(signature)
    return kept


def learn(rows: list[tuple[str, int]], precision: float = 0.85, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns entries and exceptions from (distinct folded words of a text, label) pairs; without pairs of both labels
    there are none, and the coefficients give the labelled share.

    Candidates are word beginnings and whole words; an entry is the shortest of its line whose texts are nearly all
    labelled, in more texts (near copies counted once) than chance gives any of the candidates.
    """
    docs = [(frozenset(map(intern, words.split())), label) for words, label in dict(sorted(rows)).items()]
    apart = _distinct(docs)
    toxic = [d for d, y in apart if y == 1]
    clean = [d for d, y in apart if y != 1]
    if not toxic or not clean:
        rate = sum(y == 1 for _, y in docs) / len(docs) if docs else 0.0
        base = math.log(max(rate, 1e-4) / max(1 - rate, 1e-4))
        return Lexicon((), (), (base, 0.0, 0.0))
    with_label = Counter(p for d in toxic for p in {p for w in d for p in _prefixes(w)})  # one text at a time
    twice = sum(n > 1 for n in with_label.values())
    support = max(3, math.ceil(math.log(2 + 2 * twice) / math.log((len(toxic) + len(clean)) / len(toxic))))
    known = {p for p, n in with_label.items() if n >= support}
    without = Counter(p for d in clean for p in {p for w in d for p in _prefixes(w) if p in known})
    good = {p for p in known if with_label[p] >= precision * (with_label[p] + without[p] + 0.5)}
    entries = [p for p in good if not any(p[:k] in good for k in range(4, len(p)))]
    weight = lambda p: math.log((with_label[p] + 0.5) / (len(toxic) + 1)) - math.log((without[p] + 0.5) / (len(clean) + 1))
    words_in = Counter(w for d in clean for w in d if any(f" {w} ".startswith(p) for p in entries))
    words_with = Counter(w for d, y in docs if y == 1 for w in d if w in words_in)
    learned = tuple(sorted(f" {w} " for w, n in words_in.items() if n >= 2 and n > words_with[w] and f" {w} " not in entries))
    return Lexicon(tuple((p, round(weight(p), 6)) for p in sorted(entries)), tuple(dict.fromkeys((*learned, *(fold(e) for e in exceptions)))), (0.0, 0.0, 0.0))


def calibrate(lexicon: Lexicon, points: list[tuple[float, float, int]]) -> Lexicon:
    """The lexicon with coefficients fitted to the features of whole texts and their labels."""
    if not {y == 1 for _, _, y in points} == {True, False}:
        return lexicon
    x = np.array([(1.0, a, b) for a, b, _ in points])
    y = np.array([float(label == 1) for _, _, label in points])
    b = np.zeros(3)
    for _ in range(50):  # Newton steps, a small ridge as the classes may part cleanly
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = np.diag([1e-3, 0.05, 0.05])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(float(round(v, 9)) for v in b))


def fit(rows: list[tuple[str, int]], precision: float = 0.85, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns and calibrates on (text, label) pairs held in memory."""
    lexicon = learn([(" ".join(sorted(set(fold(t).split()))), y) for t, y in rows], precision, exceptions)
    automaton = lexicon.automaton()
    return calibrate(lexicon, sorted((*features(t, automaton), y) for t, y in rows))


def fit_lexicon(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """Fits on at most `fit_rows` labelled rows for which `training` (of `labels`) holds, taken in hash order of the id.

    Entries are learnt from the texts' distinct words, coefficients from the features of the whole texts, which are
    computed where the texts are: two numbers and the label of a row come back.
    Null ids, labels and texts are left out; of repeated labels the largest counts.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .withColumn("_place", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    )
    # only about as many rows as are wanted enter the sort, however many labels there are
    share = min(1.0, 1.5 * (fit_rows + 100) / max(1, chosen.count()))
    chosen = chosen.where(F.col("_place") < int(share * (1 << 30))).orderBy("_place", "_id").limit(fit_rows).drop("_place")

    def words(batches):
        for batch in batches:
            for piece in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(set(fold(t or "").split()))) for t in piece.column(0).to_pylist()], pa.string()), piece.column(1)], names=["words", "label"])

    def points(batches):
        automaton = worker_cache(key, lexicon.automaton)
        for batch in batches:
            for piece in slices(batch, 0):
                found = np.array([features(t, automaton) for t in piece.column(0).to_pylist()]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), piece.column(1)], names=["a", "b", "label"])

    # at most fit_rows ids: a broadcast of fixed size
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id").select("_text", "_label"))
    lexicon = learn(sorted(map(tuple, rows.mapInArrow(tidied(words), "words string, label int").collect())))
    release_memory()
    key = _key(lexicon)
    return calibrate(lexicon, sorted(map(tuple, rows.mapInArrow(tidied(points), "a double, b double, label int").collect())))


def _key(lexicon: Lexicon) -> str:
    return "toxicity:" + hashlib.sha256(repr(lexicon).encode()).hexdigest()


def score_texts(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; null and empty texts get the score of a text without matches."""
    small_batches(docs.sparkSession)
    key = _key(lexicon)

    def score(batches):
        automaton = worker_cache(key, lexicon.automaton)
        for batch in batches:
            last = batch.num_columns - 1
            for piece in slices(batch, last):
                scores = [probability(features(t or "", automaton), lexicon.coefficients) for t in piece.column(last).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(scores, pa.float64())], names=[*piece.schema.names[:-1], score_col])

    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in docs.schema.fields if f.name != score_col), T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(unused(docs, "_scored"), F.col(text_col)).drop(*([score_col] if score_col != text_col else [])).mapInArrow(tidied(score), schema)


def fold_of(id_col: Column) -> Column:
    """The remainder of crc32 of the id as text by 3; rows with 1 are held out."""
    return F.crc32(id_col.cast("string")) % 3


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted.

    Labels are learnt only from rows that aren't held out. A row with a null id is never learnt from and not held out.
    Without labelled rows of both kinds every score is the labelled share (0 without any). Repeated rows get the same
    score; other columns are ignored.
    """
    lexicon = fit_lexicon(docs, labels, fold_of(F.col(id_col)) != 1, id_col, text_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    out = score_texts(rows.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "_text"), lexicon, "_text")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
