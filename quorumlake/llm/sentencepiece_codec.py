"""SentencePiece encoding and decoding on the tokenizers library: the model file is parsed, its parts rebuilt and held to parity."""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import byte_codes, make_room, prefix_hash, release_memory, slices, small_batches, span_hash, text_buffer, tidied, unused, worker_cache

SPACE_MARK = "▁"
#: Where the cluster keeps the public model files; a parameter everywhere.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words whose ids a worker keeps, before it starts afresh.
KNOWN_WORDS = 300_000
#: New words that go to the library in one line.
LINE_WORDS = 256
#: Bytes of text that are worked on at a time: each takes some hundred bytes of arrays and lists meanwhile.
PIECE_BYTES = 1 << 18

PROBES = (
    "", " ", "  ", "a", " a", "a ", "Hello world", "  two  spaces   three    four     five", "tabs\tand\nnew lines\r\n\r\n", "naïve café Übermaß ñandú",
    "日本語のテキスト", "emoji 👩‍👩‍👧‍👦 🇪🇺 🤖", "0123456789 3.14159 -42", "x" * 100, "=" * 70, "-" * 33, "<s> </s> <unk> <0x0A> <0xFF>", "▁ ▁▁ marks▁inside", "\x00\x01\x7f control", "مرحبا بالعالم", "a" * 17 + "b" * 17, "the the the theme", "  　", "fi ligature ① ℌ",
)


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    unknown: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool
    suffix_mark: bool


def _fields(raw: bytes):
    """(field number, value) pairs of a protobuf message: ints, 4-byte floats as bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value = varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = raw[at : at + size], at + size
        elif wire == 2:
            size = varint()
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"unexpected wire type {wire}")
        yield tag >> 3, value


def parse_model(raw: bytes) -> Model:
    """The parts of a ModelProto that encoding needs; absent fields get the format's defaults."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(tuple(pieces), trainer.get(3, UNIGRAM), unknown, bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)), bool(trainer.get(24, 0)))


def _pairs(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first, as a merge order."""
    usable = {p: (s, i) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, USER_DEFINED)}
    found = []
    for piece, (score, number) in usable.items():
        found += [((-score, number, usable[piece[:i]][1], usable[piece[i:]][1]), (piece[:i], piece[i:])) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
    return [pair for _, pair in sorted(found)]


def cuttable(model: Model) -> bool:
    """Whether no piece holds a space mark after another character, so that text may be cut before a blank."""
    return model.escape_spaces and not model.suffix_mark and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED))


def build_tokenizer(model: Model):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark or not model.escape_spaces:
        raise ValueError("space marks as suffixes or unescaped spaces aren't supported")
    if model.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_pairs(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        # Pieces that text can't give keep their numbers but can't be reached.
        core = models.Unigram([(p if t in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"\x00{p}", s) for p, s, t in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} isn't supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE_MARK))
    steps.append(normalizers.Replace(" ", SPACE_MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if cuttable(model):  # words are then encoded apart, which the library caches
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Words:
    """Ids of distinct words in one flat array, found by sorted 64-bit hashes."""

    def __init__(self, blank: int):
        self.blank = blank
        self.reset()

    def reset(self) -> None:
        # the empty word, whose hash is 0, is the mark alone
        self.hash, self.start, self.size, self.flat = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.blank], np.int32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted hashes aren't held."""
        return self.hash[np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)] != hashes

    def add(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        at = np.searchsorted(self.hash, hashes)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(size) - size)
        self.size, self.hash = np.insert(self.size, at, size), np.insert(self.hash, at, hashes)
        self.flat = np.concatenate([self.flat, flat])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .. in one array."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _spread(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: all from a run of blanks to the next, without the run's first blank.

    The dummy prefix stands for the blank before a text; an empty text has no words."""
    first, last = int(off[0]), int(off[-1])
    piece = data[first:last]
    full = off[:-1][np.diff(off) > 0] - first
    cut = piece == 32
    cut[1:] &= piece[:-1] != 32
    cut[full] = True
    begins = np.flatnonzero(cut)
    opens = np.zeros(len(piece) + 1, bool)
    opens[full] = True
    starts = begins + ~opens[begins]
    ends = np.concatenate([begins[1:], [len(piece)]]) if len(begins) else begins
    return starts, ends, np.searchsorted(off - first, begins, "right") - 1


class Codec:
    """A parsed model, its tokenizer, and encoding and decoding of texts."""

    def __init__(self, raw: bytes, threads: int = 2):
        from tokenizers.pre_tokenizers import Sequence

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.raw, self.model = raw, parse_model(raw)
        blank = [i for i, p in enumerate(self.model.pieces) if p[0] == SPACE_MARK][:1]
        self.cuts = cuttable(self.model) and not self.model.charsmap and not self.model.trim_spaces and self.model.dummy_prefix and bool(blank)
        self._whole = self._peer = None
        if self.cuts:
            self.words = Words(blank[0])
            self.tokenizer = build_tokenizer(self.model)
            self.tokenizer.pre_tokenizer = Sequence([])  # words come one by one
            told = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE_MARK, " ").encode() for p, _, t in self.model.pieces]
            self.size = np.array([len(p) for p in told], np.int64)
            self.start = np.cumsum(self.size) - self.size
            self.told = np.frombuffer(b"".join(told), np.uint8)
            self.begins = np.array([p[0].startswith(SPACE_MARK) for p in self.model.pieces])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of them.

        Where pieces can't reach over a word's start, texts are cut into words by array operations, each distinct word is
        encoded by the library once, and the ids are put together by their places; elsewhere whole texts are encoded."""
        if not self.cuts:
            ids = [e.ids for e in self.whole.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids], np.int64)
        data, off = text_buffer(_marked(texts))
        starts, ends, owner = _spread(data, off)
        piece = data[int(off[0]) : int(off[-1])]
        with np.errstate(over="ignore"):
            hashes = span_hash(prefix_hash(piece, byte_codes(False)), starts, ends) if len(piece) else np.zeros(0, np.uint64)
        found, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.words.hash) > KNOWN_WORDS:
            self.words.reset()
        new = np.flatnonzero(self.words.missing(found))
        if len(new):
            raw = piece.tobytes()
            begin, stop = starts[at[new]], ends[at[new]]
            # blanks inside a word stand at its start
            odd = (begin == stop) | (piece[np.minimum(begin, len(piece) - 1)] == 32)
            for part, line in ((new[~odd], LINE_WORDS), (new[odd], 1)):
                words = [raw[a:b].decode() for a, b in zip(starts[at[part]].tolist(), ends[at[part]].tolist(), strict=True)]
                self.words.add(found[part], *self._encode_words(words, line))
        spot = np.searchsorted(self.words.hash, found)[which]
        sizes = self.words.size[spot]
        return self.words.flat[_ranges(self.words.start[spot], sizes)], np.bincount(owner, weights=sizes, minlength=len(off) - 1).astype(np.int64)

    def _encode_words(self, words: list[str], line: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of them.

        Words without blanks go to the library several in a line: each begins at an id with the mark and has no other."""
        lines = [" ".join(words[i : i + line]) for i in range(0, len(words), line)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat, sizes = np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids], np.int64)
        return flat, sizes if line == 1 else np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))

    def verified(self, texts: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """flat, sizes, and for each whole text: whether the sentencepiece library gives the same ids, and whether the ids
        stand for the text. A text whose ids don't stand for it is encoded whole and looked at again."""
        round_trip = self._back(texts, flat, sizes)
        values = pc.fill_null(texts, "").to_pylist()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        again = [i for i in np.flatnonzero(~round_trip).tolist() if SPACE_MARK not in values[i]] if self.cuts else []
        if again:
            parts = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i in again:
                parts[i] = np.array(self.whole.encode(values[i], add_special_tokens=False).ids, np.int32)
                round_trip[i] = self.decode([parts[i].tolist()])[0] == values[i]
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        want = self.peer().encode(values, num_threads=1)
        lengths = np.array([len(w) for w in want], np.int64)
        parity = lengths == sizes
        other = np.fromiter(chain.from_iterable(want), np.int32, int(lengths.sum()))
        if not (parity.all() and (other == flat).all()):
            ends = np.cumsum(lengths)
            for i in np.flatnonzero(parity).tolist():
                parity[i] = (flat[bounds[i] : bounds[i + 1]] == other[ends[i] - lengths[i] : ends[i]]).all()
        return flat, sizes, parity, round_trip

    def _back(self, texts: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the pieces' own texts, one after another, are each text after the dummy prefix."""
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not self.cuts:
            ids = [flat[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return np.array([a == b for a, b in zip(self.decode(ids), pc.fill_null(texts, "").to_pylist(), strict=True)], bool)
        data, off = text_buffer(texts)
        told = self.told[_ranges(self.start[flat], self.size[flat])]
        ends = np.concatenate([[0], np.cumsum(self.size[flat])])[bounds]
        lengths = np.diff(off)
        prefix = (lengths > 0).astype(np.int64)  # the blank that the dummy prefix gives
        same = np.diff(ends) == lengths + prefix
        full = np.flatnonzero(same & (prefix > 0))
        mine = _ranges(ends[:-1][full] + 1, lengths[full])
        equal = told[mine] == data[_ranges(off[:-1][full], lengths[full])]
        if len(full) and not equal.all():
            same[full] &= np.logical_and.reduceat(equal, np.cumsum(lengths[full]) - lengths[full])
        return same

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, sizes = self.encode_column(pa.array(texts, pa.string()))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return [flat[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    @property
    def whole(self):
        """The tokenizer of whole texts, built when it is first asked for: where texts are cut, few workers meet a text that needs it."""
        if self._whole is None:
            self._whole = build_tokenizer(self.model)
        return self._whole

    def peer(self):
        import sentencepiece

        if self._peer is None:
            self._peer = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return self._peer

    def check(self, texts=PROBES) -> None:
        """Raises unless the ids are the sentencepiece library's, and what they stand for is the same by the pieces' own
        texts and by the tokenizers library's decoder."""
        column = pa.array(list(texts), pa.string())
        ids = self.encode(list(texts))
        for text, got, want in zip(texts, ids, self.peer().encode(list(texts), num_threads=1), strict=True):
            if got != want:
                raise ValueError(f"encoding differs from sentencepiece for {text[:60]!r}: {got[:20]} and {want[:20]}")
        back = self._back(column, *self.encode_column(column))
        for text, same, told in zip(texts, back.tolist(), self.decode(ids), strict=True):
            if same != (told == text):
                raise ValueError(f"decoding differs from the pieces' own texts for {text[:60]!r}")


def _marked(texts: pa.Array) -> pa.Array:
    """Marks in a text count as blanks."""
    return pc.replace_substring(texts, SPACE_MARK, " ") if pc.any(pc.match_substring(texts, SPACE_MARK)).as_py() else texts


def load_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _codec(raw: bytes, threads: int) -> Codec:
    return worker_cache(f"sp:{threads}:" + hashlib.sha256(raw).hexdigest(), lambda: Codec(raw, threads))


def encode_documents(docs: DataFrame, raw: bytes, text_col: str = "text", threads: int = 2, verify: bool = True) -> DataFrame:
    """docs with ids array<int>, n_tokens and, with verify, parity and round_trip.

    raw is the model file's content (megabytes at most; it travels with the tasks). Pieces of PIECE_BYTES of text (or one
    text) go to the library's threads. A fixed list of texts is held to parity before the job starts. With verify, every whole text
    is encoded by the sentencepiece library too (parity: the same ids) and its ids are put back into text (round_trip:
    the same bytes; false where the model normalises or trims, or the text holds the mark U+2581).

    Null and empty texts have no ids, and count as the empty text. All rows are kept, repeated ones too, and an empty
    table gives none. All columns are kept; one that has a new name (in any case) gets underscores after its own.
    """
    small_batches(docs.sparkSession)
    Codec(raw, threads).check()
    release_memory()
    new = {"ids": "array<int>", "n_tokens": "long", **({"parity": "boolean", "round_trip": "boolean"} if verify else {})}
    docs = docs.withColumn(unused(docs, "_encoded"), F.coalesce(F.col(text_col), F.lit("")))
    base = make_room(docs, list(new))
    kept = base.columns[:-1]

    def encode(batches):
        codec = _codec(raw, threads)
        for batch in batches:
            for piece in slices(batch, batch.num_columns - 1, PIECE_BYTES):
                texts = piece.column(piece.num_columns - 1)
                flat, sizes = codec.encode_column(texts)
                verdicts = []
                if verify:
                    flat, sizes, *verdicts = codec.verified(texts, flat, sizes)
                off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                columns = [pa.ListArray.from_arrays(off, pa.array(flat)), pa.array(sizes), *(pa.array(v, pa.bool_()) for v in verdicts)]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(kept))), *columns], names=[*kept, *new])

    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields[:-1], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])
    return base.mapInArrow(tidied(encode), schema)


def decode_documents(encoded: DataFrame, raw: bytes, ids_col: str = "ids", out_col: str = "text", threads: int = 2) -> DataFrame:
    """encoded with the text that each row's ids stand for; null or empty ids give the empty text.

    All rows and columns are kept; one named as the new one (in any case) gets underscores after its own name. An empty
    table gives no rows."""
    from pyspark.sql import types as T

    small_batches(encoded.sparkSession)
    base = make_room(encoded.withColumn(unused(encoded, "_ids"), F.col(ids_col)), [out_col])
    schema = T.StructType([*base.schema.fields[:-1], T.StructField(out_col, T.StringType())])

    def decode(batches):
        codec = _codec(raw, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = pc.fill_null(piece.column(piece.num_columns - 1), []).to_pylist()
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(codec.decode(ids), pa.string())], names=[*piece.schema.names[:-1], out_col])

    return base.mapInArrow(tidied(decode), schema)
