"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier are removed, the first copy stays.

A longest-previous-factor array holds, for each position, the longest match with an earlier start; it comes from the
previous and next smaller positions in suffix order. A position opens a repeat when its entry reaches `length`.

One suffix array over the corpus would be one machine's; this one is dealt out. Two equal strings of `length` bytes share
their minimizer (the leftmost smallest hash of a gram in them), at the same place. So positions go by the minimizer of
the `length` bytes that start there, a run of consecutive positions with one minimizer as one fragment:

1. Minimizers are counted; those that occur once can't open a repeat and are gone.
2. Equal fragments (same minimizer, and two 64-bit hashes of the bytes) are one, with their first place. All later copies
   are wholly repeats. Equal fragments side by side, as in periodic text, are one row.
3. Where a minimizer has several different fragments, their bytes are put in suffix order by task, with the lengths that
   neighbours share, and the longest-previous-factor array tells which positions open a repeat.
4. A minimizer with very many different fragments has them cut to single positions, which are dealt out by their own
   strings: equal ones are one again, and nothing is left to sort.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import byte_codes, flag_in, join_hot, mix, powers, prefix_hash, slices, small_batches, span_hash, text_buffer, tidied, written

LENGTH, GRAM = 100, 32
#: Window starts handled at a time, from a text's own start; a place among them takes 20 bits.
RANGE = 1_000_000
#: 64-bit words of the bitmaps that tell tasks which minimizers matter: a fixed size at any input.
BITMAP_WORDS = 1 << 19
#: Different fragments of one minimizer that one task sorts; more are dealt out by the hash of each string.
TOGETHER = 4096
#: Bytes of fragments sorted at a time.
SORTED_BYTES = 1 << 20


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF by position, from suffix order (positions) and lcp[i] of order[i - 1] and order[i] (lcp[0] is 0).

    Positions leave from the last to the first; what then stand about a position in suffix order are its previous and next
    smaller positions, and the lengths shared with them are kept as minima.
    """
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    shared = [*lcp.tolist(), 0]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    for position, r in zip(range(n - 1, -1, -1), rank[::-1].tolist(), strict=True):
        before, after = left[r], right[r]
        a, b = shared[r], shared[after]
        out[position] = a if a > b else b
        shared[after] = a if a < b else b
        if before >= 0:
            right[before] = after
        if after < n:
            left[after] = before
    return np.array(out, np.int64)


def _chunks(off: np.ndarray, length: int):
    """(first, last byte) of ranges of whole texts, or of parts of a long one, so that a text is always cut alike."""
    begin = int(off[0])
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - begin <= RANGE:
            continue
        if a > begin:
            yield begin, a
        begin = a
        while b - begin > RANGE:
            yield begin, min(begin + RANGE + length - 1, b)
            begin += RANGE
        if a < begin:  # the rest of a long text
            yield begin, b
            begin = b
    if begin < int(off[-1]):
        yield begin, int(off[-1])


def fragments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(minimizer hash, fragment hash, text number, start in the text, positions, times) of the fragments of consecutive
    texts; a fragment that comes several times side by side is one with its times."""
    span = length - gram + 1
    codes = byte_codes(False)
    for lo, hi in _chunks(off, length):
        piece = data[lo:hi]
        windows = len(piece) - length + 1
        if windows <= 0:
            continue
        cs = prefix_hash(piece, codes)
        _, q = powers(len(piece) + 1)
        grams = len(piece) - gram + 1
        code = mix((cs[gram:] - cs[:grams]) * q[:grams])
        low = (code & ~np.uint64(0xFFFFF)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:windows], low[span - width : span - width + windows])
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        # windows may not reach over the end of a text
        steps = np.zeros(windows + 1, np.int64)
        ends = off[1:][(off[1:] > lo) & (off[1:] < hi + length)] - lo
        begins = off[:-1][(off[1:] > lo) & (off[1:] < hi + length)] - lo
        np.add.at(steps, np.clip(np.maximum(ends - length + 1, begins), 0, windows), 1)
        np.add.at(steps, np.clip(ends, 0, windows), -1)
        place = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
        if not len(place):
            continue
        chosen = at[place]
        new = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(place) != 1)) + 1
        a, b = place[np.concatenate([[0], new])], place[np.concatenate([new - 1, [len(place) - 1]])]
        h, f, n = code[at[a]], span_hash(cs, a, b + length), b - a + 1
        number = np.searchsorted(off, a + lo, "right") - 1
        again = (h[1:] == h[:-1]) & (f[1:] == f[:-1]) & (n[1:] == n[:-1]) & (number[1:] == number[:-1]) & (a[1:] == b[:-1] + 1)
        first = np.concatenate([[0], np.flatnonzero(~again) + 1])
        times = np.diff(np.append(first, len(a)))
        yield h[first], f[first], number[first], a[first] + lo - off[number[first]], n[first], times


def suffix_order(buffer: np.ndarray, left: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions of buffer with `least` or more bytes left, where the suffix at i has left[i] bytes, and
    the lengths that neighbours in it share (0 first). Equal suffixes stand by position.

    Suffixes are put in order by seven bytes, then those equal so far by the next seven, until all have parted or ended; a
    group whose next bytes are in order already isn't sorted."""
    n = len(buffer)
    bytes_ = np.concatenate([buffer, np.zeros(7, np.uint8)]).astype(np.uint64)
    two = (bytes_[:-1] << np.uint64(8)) | bytes_[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    count = np.minimum(left, 7)
    mask = np.array([0, *(((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 8))], np.uint64)
    # seven bytes (zeros behind the end), then how many of them there are
    word = (((four[:n] << np.uint64(32)) | ((four[3 : n + 3] & np.uint64(0xFFFFFF)) << np.uint64(8))) & mask[count]) | count.astype(np.uint64)

    order = np.flatnonzero(left >= least)
    order = order[np.argsort(word[order], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    place, group, depth = np.arange(len(order)), np.zeros(len(order), np.int64), 0
    while len(place) > 1:
        at = order[place]
        code = np.where(left[at] > depth, word[np.minimum(at + depth, n - 1)], np.uint64(0))
        together = group[1:] == group[:-1]
        down = together & (code[1:] < code[:-1])
        if down.any():
            messy = np.zeros(int(group[-1]) + 1, bool)
            messy[group[1:][down]] = True
            some = np.flatnonzero(messy[group])
            by = some[np.lexsort((code[some], group[some]))]
            at[some], code[some] = at[by], code[by]
            order[place] = at
        equal = together & (code[1:] == code[:-1])
        parted = np.flatnonzero(together & ~equal)
        apart = code[parted] ^ code[parted + 1]
        common = sum((apart >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 8)) + depth
        shared[place[parted + 1]] = np.minimum(common, np.minimum(left[at[parted]], left[at[parted + 1]]))
        going = equal & ((code[1:] & np.uint64(255)) == 7)
        ended = np.flatnonzero(equal & ~going) + 1
        shared[place[ended]] = left[at[ended]]
        stays = np.append(going, False) | np.insert(going, 0, False)
        number = np.insert(np.cumsum(~going), 0, 0)[stays]
        place, group = place[stays], np.cumsum(np.diff(number, prepend=number[:1]) != 0)
        depth += 7
    return order, shared


def repeats(pieces: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(piece, first, last position) of the runs of positions that open a repeat of an earlier piece or place.

    pieces are in corpus order; a position of a piece has `length` bytes from it on.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    if not len(sizes):
        return []
    owner = np.repeat(np.arange(len(pieces)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order, shared = suffix_order(np.frombuffer(b"".join(pieces), np.uint8), sizes[owner] - inner, length)
    # a suffix that shares `length` bytes with no neighbour opens nothing and parts those about it: only others go on
    near = np.maximum(shared, np.append(shared[1:], 0)) >= length
    if not near.any():
        return []
    kept, at = order[near], np.flatnonzero(near)
    between = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
    numbers = np.sort(kept)
    opens = longest_previous_factor(np.searchsorted(numbers, kept), between) >= length
    hit = numbers[opens]
    if not len(hit):
        return []
    new = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
    firsts, lasts = hit[np.concatenate([[0], new])], hit[np.concatenate([new - 1, [len(hit) - 1]])]
    return list(zip(owner[firsts].tolist(), inner[firsts].tolist(), inner[lasts].tolist(), strict=True))


def _digests(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """64 bits of a cryptographic hash of each span."""
    raw = b"".join(hashlib.blake2b(data[a : a + n], digest_size=8).digest() for a, n in zip(begin.tolist(), size.tolist(), strict=True))
    return pa.array(np.frombuffer(raw, np.int64))


def _bitmap(keys: DataFrame, key: str, words: int) -> np.ndarray:
    """A one-hash bitmap of the keys, `words` * 8 bytes at any input size, as it goes to every task."""
    slot = F.col(key).bitwiseAND(F.lit(words * 64 - 1))
    rows = keys.select(slot.alias("_b")).groupBy(F.expr("_b div 64").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _among(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, words: int = BITMAP_WORDS) -> DataFrame:
    """(doc_id, _fp, lo, hi): byte ranges of rows (doc_id, _fp, _text) to remove; they may overlap."""
    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    context = rows.sparkSession.sparkContext

    def count(batches):
        def summed(parts):
            keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, weights=times)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

        parts, size = [], 0
        for h, *_, times in (f for batch in batches for piece in slices(batch, 0) for f in fragments(*text_buffer(piece.column(0)), length, gram)):
            parts.append((h, times))
            size += len(h)
            if size > 1_000_000:
                yield summed(parts)
                parts, size = [], 0
        if parts:
            yield summed(parts)

    shared = rows.select("_text").mapInArrow(tidied(count), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = context.broadcast(_bitmap(shared, "h", words))

    def place(batches):
        for batch in batches:
            for piece in slices(batch, 2):
                data, off = text_buffer(piece.column(2))
                for h, f, number, start, n, times in fragments(data, off, length, gram):
                    keep = np.flatnonzero(_among(h, wanted.value))
                    take = pa.array(number[keep])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[keep].view(np.int64)), pa.array(f[keep].view(np.int64)), _digests(data, off[number[keep]] + start[keep], n[keep] + length - 1), piece.column(0).take(take), piece.column(1).take(take), *(pa.array(x[keep]) for x in (start, n, times))],
                        names=["h", "f", "g", "doc_id", "_fp", "at", "n", "times"],
                    )

    placed = written(rows.select("doc_id", "_fp", "_text").mapInArrow(tidied(place), f"h long, f long, g long, doc_id {kind}, _fp long, at long, n long, times long"))
    firsts = placed.groupBy("h", "f", "g").agg(F.min(F.struct("doc_id", "_fp", "at")).alias("first"), F.sum("times").alias("places"), F.count("*").alias("rows"))
    firsts = written(firsts.select("h", "f", "g", "first.*", "places", "rows"))

    # later copies of a fragment: repeats throughout, but for the first place
    again = firsts.where("places > 1").select("h", "f", "g", F.col("doc_id").alias("_d"), F.col("_fp").alias("_p"), F.col("at").alias("_a"), "rows")
    keyed = F.struct("h", "f", "g")
    met = join_hot(placed.withColumn("_k", keyed), again.withColumn("_k", keyed).drop("h", "f", "g"), "_k", "rows")
    whole_copy = F.expr("not (doc_id <=> _d and _fp = _p and at = _a)")
    later = met.where(whole_copy | (F.col("times") > 1)).select("doc_id", "_fp", F.when(whole_copy, F.col("at")).otherwise(F.col("at") + F.col("n")).alias("lo"), (F.col("at") + F.col("n") * F.col("times") - 1 + length).alias("hi"))

    # different fragments of one minimizer
    contexts = written(firsts.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    several = written(join_hot(firsts, contexts.withColumn("_weight", F.col("contexts")), "h", "_weight").select("h", "f", "g", "doc_id", "_fp", "at", "contexts"))
    read = context.broadcast(_bitmap(several.select(F.col("h").bitwiseXOR(F.col("f")).alias("k")), "k", words))

    def cut(batches):
        for batch in batches:
            for piece in slices(batch, 2):
                data, off = text_buffer(piece.column(2))
                for h, f, number, start, n, _ in fragments(data, off, length, gram):
                    keep = np.flatnonzero(_among(h ^ f, read.value))
                    take = pa.array(number[keep])
                    begin = off[number[keep]] + start[keep]
                    raw = [data[b:e].tobytes() for b, e in zip(begin.tolist(), (begin + n[keep] + length - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(f[keep].view(np.int64)), piece.column(0).take(take), piece.column(1).take(take), pa.array(start[keep]), pa.array(raw, pa.binary())], names=["h", "f", "doc_id", "_fp", "at", "raw"])

    key = several.select(F.col("h").alias("_h"), F.col("f").alias("_f"), F.col("doc_id").alias("_d"), F.col("_fp").alias("_p"), F.col("at").alias("_a"), "contexts")
    cuts = rows.select("doc_id", "_fp", "_text").mapInArrow(tidied(cut), f"h long, f long, doc_id {kind}, _fp long, at long, raw binary")
    whole = written(cuts.join(key, F.expr("h = _h and f = _f and doc_id <=> _d and _fp = _p and at = _a")).select("h", "f", "doc_id", "_fp", "at", "raw", "contexts").dropDuplicates(["h", "f", "at", "doc_id", "_fp"]))

    def sort(batches):
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table):
            ids, fps, ats, raws = (table.column(c).to_pylist() for c in ("doc_id", "_fp", "at", "raw"))
            ordered = sorted(range(len(raws)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, fps[i], ats[i]))
            found = repeats([raws[i] for i in ordered], length)
            at = [ordered[p] for p, _, _ in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], table.schema.field("doc_id").type), pa.array([fps[i] for i in at], pa.int64()), pa.array([ats[i] + a for i, (_, a, _) in zip(at, found, strict=True)], pa.int64()), pa.array([ats[i] + b + length for i, (_, _, b) in zip(at, found, strict=True)], pa.int64())],
                names=["doc_id", "_fp", "lo", "hi"],
            )

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < SORTED_BYTES:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cuts_at = np.flatnonzero(np.diff(h)) + 1  # rows of the last minimizer wait for the next batch
            start = 0
            step = max(1, int(len(h) * SORTED_BYTES / table.nbytes))
            while len(cuts_at) and start < cuts_at[-1]:
                stop = int(cuts_at[min(np.searchsorted(cuts_at, start + step), len(cuts_at) - 1)])
                yield solve(table.slice(start, stop - start))
                start = stop
            held = table.slice(start).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    sorted_ = whole.where(F.col("contexts") <= together).select("h", "f", "doc_id", "_fp", "at", "raw").repartition("h").sortWithinPartitions("h").mapInArrow(tidied(sort), f"doc_id {kind}, _fp long, lo long, hi long")

    # minimizers with very many fragments: each string by its own hash, the first place by a pre-aggregated minimum
    strings = whole.where(F.col("contexts") > together).select("doc_id", "_fp", "at", "raw", F.explode(F.expr(f"sequence(0, octet_length(raw) - {length})")).alias("i")).select("doc_id", "_fp", (F.col("at") + F.col("i")).alias("lo"), F.md5(F.expr(f"substring(raw, i + 1, {length})")).alias("s"))
    origin = strings.groupBy("s").agg(F.min(F.struct("doc_id", "_fp", "lo")).alias("o"), F.count("*").alias("c")).where("c > 1").select("s", F.col("o.doc_id").alias("_d"), F.col("o._fp").alias("_p"), F.col("o.lo").alias("_a"))
    dealt = strings.join(origin, "s").where("not (doc_id <=> _d and _fp = _p and lo = _a)").select("doc_id", "_fp", "lo", (F.col("lo") + length).alias("hi"))
    return later.unionByName(sorted_).unionByName(dealt)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, keep_text: bool = False) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes (binary).

    Each byte covered by a string of `length` bytes that also starts earlier (smaller id, or earlier in the same text) is
    removed; strings never reach over texts and are judged on the input. Null and empty texts have no bytes. A null id is
    smaller than any other. Rows with one id and different texts are ordered by a hash of the text; equal rows count as
    one text and get equal results. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    spans = repeated_spans(rows, length, gram, together).groupBy("doc_id", "_fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = written(spans)  # a row a text, as many spans as its length allows
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            lists = batch.column(2)
            bounds, lo, hi = lists.offsets.to_numpy(), lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            rows = []
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]]
                steps = np.zeros(len(raw) + 1, np.int64)
                np.add.at(steps, lo[bounds[i] : bounds[i + 1]], 1)
                np.add.at(steps, hi[bounds[i] : bounds[i + 1]], -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = raw[~gone].tobytes()
                rows.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0).sum()), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    flagged = flag_in(rows, "_fp", spans.select("_fp"))
    join = spans.select(F.col("doc_id").alias("_d"), F.col("_fp").alias("_p"), "spans")
    touched = flagged.where("_flag").join(join, F.expr("doc_id <=> _d and _fp = _p"), "left")
    changed = touched.select("doc_id", "_text", F.coalesce("spans", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")).alias("spans")).mapInArrow(tidied(cut), schema)
    zero = F.lit(0).cast("long")
    untouched = flagged.where("not _flag").select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"), F.when(F.lit(keep_text), F.col("_text").cast("binary")).alias("kept"))
    out = untouched.unionByName(changed)
    return out if keep_text else out.drop("kept")
