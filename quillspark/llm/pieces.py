"""SentencePiece encoding that keeps byte offsets, and decoding.

A text is normalised here: at each place the longest key of the model's compiled character map (a
double-array trie) is replaced, white space becomes the meta symbol, and every normalised byte
remembers the original byte it came from. The library then encodes the normalised text with a copy
of the model whose own normaliser is switched off, so the lengths of the pieces project each piece
to a span of original bytes. A model whose pieces never hold the meta symbol after another
character is encoded by distinct segments (see segments.py); others by whole texts.

Defined results: null text is empty and has the end id only; an empty table gives an empty result;
rows that repeat are treated alike. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, lean, small_batches
from .segments import SegmentEncoder, by_text, chunks, distinct, encoded

META = "▁"
META_BYTES = META.encode()
UNKNOWN, NORMAL, CONTROL, BYTE = 2, 1, 3, 6  # kinds of pieces in a model file


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, object, bytes]]:
    """number, value and raw bytes of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        begin = i
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value, b[begin:i]


@dataclass
class Trie:
    """The compiled character map: a double array of 32-bit units, and the replacements."""

    units: np.ndarray
    targets: bytes

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest key at b[i:], and its replacement."""
        units, found = self.units, None
        u = int(units[0])
        at = u >> 10 << ((u & 1 << 9) >> 6)
        for j in range(i, len(b)):
            at ^= b[j]
            if at >= len(units):
                break
            u = int(units[at])
            if u & 0x800000FF != b[j]:
                break
            at ^= u >> 10 << ((u & 1 << 9) >> 6)
            if u >> 8 & 1:
                found = j + 1 - i, int(units[at]) & 0x7FFFFFFF
        if found is None:
            return None
        end = self.targets.index(b"\0", found[1])
        return found[0], self.targets[found[1] : end]


class Normaliser:
    """The normaliser of a model file, with source alignment."""

    def __init__(self, spec: bytes):
        self.prefix, self.squeeze, self.escape, chars = True, True, True, b""
        for number, value, _ in _fields(spec):
            if number == 2:
                chars = value
            elif number == 3:
                self.prefix = bool(value)
            elif number == 4:
                self.squeeze = bool(value)
            elif number == 5:
                self.escape = bool(value)
        self.trie = None
        if chars:
            n = int.from_bytes(chars[:4], "little")
            self.trie = Trie(np.frombuffer(chars[4 : 4 + n], "<u4"), chars[4 + n :])
            begins = [b for b in range(256) if self._begins(b)]
            self.special = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in begins) + b"]") if begins else None

    def _begins(self, byte: int) -> bool:
        units = self.trie.units
        u = int(units[0])
        at = (u >> 10 << ((u & 1 << 9) >> 6)) ^ byte
        return at < len(units) and int(units[at]) & 0x800000FF == byte

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original byte."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.trie is None and not self.squeeze and self.escape:
            source = np.frombuffer(raw, np.uint8)
            at = np.repeat(np.arange(len(raw) + 1), np.append(np.where(source == 32, 3, 1), 1))
            out = text.replace(" ", META)
            return (META + out, np.concatenate([[0, 0, 0], at])) if self.prefix else (out, at)
        return self._general(raw)

    def _steps(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """begin, end and replacement of each stretch of the original bytes."""
        i = 0
        while i < len(raw):
            if self.trie is not None:
                m = self.special.search(raw, i) if self.special else None
                stop = m.start() if m else len(raw)
                for j in range(i, stop):
                    yield j, j + 1, raw[j : j + 1]
                i = stop
                if i == len(raw):
                    return
                found = self.trie.longest(raw, i)
                n = found[0] if found else (1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4)
                yield i, i + n, found[1] if found else raw[i : i + n]
                i += n
            else:
                yield i, i + 1, raw[i : i + 1]
                i += 1

    def _general(self, raw: bytes) -> tuple[str, np.ndarray]:
        out, at = bytearray(), []
        space = META_BYTES if self.escape else b" "
        if self.prefix:
            out += space
            at += [0] * len(space)
        started, after_space = False, self.squeeze
        for begin, _, new in self._steps(raw):
            for k in range(len(new)):
                c = new[k : k + 1]
                if c == b" ":
                    if self.squeeze and after_space:
                        continue
                    out += space
                    at += [begin] * len(space)
                    after_space = True
                else:
                    out += c
                    at.append(begin)
                    after_space = False
                started = True
        if not started:
            return "", np.array([len(raw)])
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                del at[-len(space) :]
        return out.decode(errors="replace"), np.array([*at, len(raw)])


class Pieces:
    """A model file: encode to ids and byte spans, decode."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec, rest, names, kinds = b"", [], [], []
        for number, value, raw in _fields(model):
            if number == 3:
                spec = value
                continue
            rest.append(raw)
            if number == 1:
                piece = {n: v for n, v, _ in _fields(value)}
                names.append(piece.get(1, b""))
                kinds.append(piece.get(3, NORMAL))
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escape
        self.normalise = Normaliser(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(plain)]) + plain)
        self.lengths = np.array([1 if k == BYTE else len(n) for n, k in zip(names, kinds, strict=True)])
        self.words = [str(i) for i in range(len(names))]
        self.has_bytes = sum(k == BYTE for k in kinds) == 256
        self.end_id = self.library.eos_id()
        inner = re.compile(f"[^{META}]{META}")
        self.local = self.has_bytes and not any(k == NORMAL and inner.search(n.decode()) for n, k in zip(names, kinds, strict=True))
        self.known = SegmentEncoder(lambda segments: encoded(self.bare.encode([x.decode() for x in segments], num_threads=1)), 300_000, 3_000_000)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of normalised texts one after the other, and the number of ids of each text."""
        parts = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw, ends = b"".join(parts), np.cumsum(sizes)
        data = np.frombuffer(raw, np.uint8)
        marks = np.zeros(len(data) + 1, bool)
        marks[ends - sizes] = True
        if self.local and len(data):  # a segment is a run of meta symbols and what follows it
            meta = np.zeros(len(data) + 3, bool)
            meta[3:-2] = (data[:-2] == META_BYTES[0]) & (data[1:-1] == META_BYTES[1]) & (data[2:] == META_BYTES[2])
            marks[:-1] |= meta[3:] & ~meta[:-3]
        starts = np.flatnonzero(marks[:-1])
        ids, counts = self.known(*distinct(raw, starts))
        return ids, by_text(counts, starts, ends)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, with the end id, and the first and last (exclusive) original byte of each."""
        normal = [self.normalise(t) for t in texts]
        ids, sizes = self.ids_of([n for n, _ in normal])
        out, end = [], 0
        for (norm, at), size in zip(normal, sizes.tolist(), strict=True):
            own = ids[end : end + size]
            end += size
            lengths = self.lengths[own]
            if not self.has_bytes and lengths.sum() != len(at) - 1:  # unknown pieces span what no piece names
                lengths = np.array([len(p.surface.encode()) for p in self.bare.encode(norm, return_type="proto").pieces])
            ends = np.cumsum(lengths)
            last = at[-1]
            out.append((np.append(own, self.end_id), np.append(at[ends - lengths], last), np.append(at[ends], last)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


REAL = "ids array<int>, byte_starts array<int>, byte_ends array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The kept columns with ids, byte spans and decoded text, or with digests of these. Columns with a
    name of the result are not kept."""
    taken = {x.split()[0] for x in (DIGESTS if digests else REAL).split(", ")} | {"_text"}
    keep = [c for c in docs.columns if c not in taken] if keep is None else keep
    rows = small_batches(docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    new = StructType.fromDDL(DIGESTS if digests else REAL)
    schema, names = StructType([*rows.schema.fields[:-1], *new.fields]), new.names
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digests else [pa.list_(pa.int32())] * 3 + [pa.string()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = b.column("_text").to_pylist()
            for s in chunks(texts, 1 << 19):
                found = m.encode(texts[s])
                lists = [ids.tolist() for ids, _, _ in found]
                decoded = m.decode(lists)
                if digests:
                    cols = [
                        [len(x) for x in lists],
                        [hashlib.sha256(" ".join(map(m.words.__getitem__, x)).encode()).hexdigest() for x in lists],
                        [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
                        [zlib.crc32(np.concatenate([a, z]).astype("<i8").tobytes()) for _, a, z in found],
                    ]
                else:
                    cols = [lists, [a.tolist() for _, a, _ in found], [z.tolist() for _, _, z in found], decoded]
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document that arrives.

    Defined results: null text is empty; rows that repeat, and null ids, give a row each; other
    columns are not looked at; an empty table gives none."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True)
