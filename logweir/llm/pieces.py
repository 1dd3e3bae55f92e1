"""SentencePiece models run by the tokenizers library: read from their protobuf, rebuilt, held to parity."""

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, rows_of
from logweir.llm.word_ids import gather

# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"

#: Threads that encode a batch, and segments that a task keeps.
THREADS, KNOWN = 2, 300_000


@dataclass
class Model:
    """What a model file says: pieces with score and type, and the settings that encoding needs."""

    pieces: list[tuple[str, float, int]]
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    one_space: bool
    byte_fallback: bool
    unknown: int


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            value: int | bytes = varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            value, at = raw[at:at + size], at + size
        yield key >> 3, value


def read_model(raw: bytes) -> Model:
    """A model file; fields that it leaves out have the format's defaults."""
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(raw):
        if field == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode("utf-8"), score, own.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Model(pieces, trainer.get(3, UNIGRAM), normaliser.get(2, b""), bool(normaliser.get(3, 1)),
                 bool(normaliser.get(4, 1)), bool(trainer.get(35, 0)), unknown)


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every cut of a piece into two pieces, best-scored pieces first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: Model, prefix: bool = True):
    """The model as a tokenizer: normaliser, marker, pieces with their scores or merges, byte fallback."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), fuse_unk=True,
                          unk_token=model.pieces[model.unknown][0], byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of type {model.kind} are neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.one_space:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    own = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens([AddedToken(p, normalized=True) for p in own])
    return tokenizer


def cuts_at_markers(model: Model) -> bool:
    """Whether a text may be cut before each run of spaces: no piece goes on beyond one, and normalising
    changes no character."""
    inside = re.compile(f"[^{MARK}]{MARK}")
    return not model.charsmap and not model.one_space and model.dummy_prefix and not any(
        inside.search(p) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


_SEGMENT = re.compile(r" *[^ ]+| +")


class Pieces:
    """Encodes batches of texts. Where the model lets texts be cut at markers, segments are encoded once and
    kept in a bounded table; otherwise whole texts are."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.model, self.threads = read_model(raw), threads
        self.whole = rebuild(self.model)
        self.cuts = cuts_at_markers(self.model)
        self.part = rebuild(self.model, prefix=False) if self.cuts else None
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.flat, self.same = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, bool)

    def _library(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        ids = self._library(self.part, new)
        # The other library puts the first space of a segment before it by itself.
        want = self.other.encode([s[1:] for s in new], num_threads=self.threads)
        if " " in new:  # an empty text has no marker there
            want[new.index(" ")] = [self.other.piece_to_id(MARK)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.starts) - 1
        self.places.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int32)])
        self.same = np.concatenate([self.same, np.array([a == b for a, b in zip(ids, want, strict=True)], bool)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether the model's own library gives the same: for all its segments,
        or for the whole text; the first text of a batch is compared as a whole in any case."""
        if not self.cuts:
            ids, want = self._library(self.whole, texts), self.other.encode(texts, num_threads=self.threads)
            return [np.array(x, np.int32) for x in ids], [a == b for a, b in zip(ids, want, strict=True)]
        if len(self.places) > KNOWN:
            self.clear()
        cut = [_cut(" " + t) if t else [] for t in texts]
        flat = [s for own in cut for s in own]
        new = list(set(flat).difference(self.places))
        if new:
            self._learn(new)
        use = np.array(list(map(self.places.__getitem__, flat)), np.int64)
        ids, ends = gather(self.starts, self.flat, use)
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in cut])])
        at = np.concatenate([[0], ends])[bounds]
        good = np.concatenate([[0], np.cumsum(~self.same[use])])[bounds]
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        same = [bool(a == b) for a, b in zip(good, good[1:], strict=False)]
        if texts:
            same[0] = same[0] and out[0].tolist() == self.other.encode(texts[0]) == self._library(self.whole, texts[:1])[0]
        return out, same


def _cut(text: str) -> list[str]:
    if "  " in text or text.endswith(" "):
        return _SEGMENT.findall(text)
    return [" " + w for w in text[1:].split(" ")]


def piece_bytes(model: Model) -> list[bytes]:
    """What each id stands for in a text: a byte, a piece with its markers as spaces, or nothing."""
    plain = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
    return [plain.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in model.pieces]


def encode_texts(docs: DataFrame, raw: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id, ids, parity (the model's own library agrees) and the crc32 of each whole text.

    A null or empty text has no ids. There is no shuffle; a task holds few texts at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("parity", pa.bool_()), ("text_crc32", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(raw, threads)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, same = coder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                sums = [zlib.crc32(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(same), pa.array(sums, pa.int64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(own, encode, "doc_id long, ids array<int>, parity boolean, text_crc32 long")


def decode_ids(encoded: DataFrame, raw: bytes) -> DataFrame:
    """The columns of ``encoded`` with ``text``, its ids decoded; the marker put first is taken off again."""
    names = encoded.columns
    dropped = 1 if read_model(raw).dummy_prefix else 0

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(read_model(raw))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column(names.index("ids"))
                texts = []
                for own in lists:
                    whole = b"".join([table[i] for i in own.values.to_numpy()]) if own.is_valid else b""
                    texts.append(whole[dropped if whole[:1] == b" " else 0:].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, decode, f"{fields}, text string")


def round_trip(docs: DataFrame, raw: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as text), parity, and whether decoding gives the text back."""
    back = decode_ids(encode_texts(docs, raw, threads), raw)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        "parity", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("restored"))
