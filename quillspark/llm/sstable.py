"""Token ids in sorted-string-table shards.

Documents are range-partitioned by id and sorted; each partition becomes one shard file. A shard
holds prefix-compressed, deflated blocks, then a sparse index (one entry for each block), a Bloom
filter of the keys and a footer:

  block   entries of: bytes shared with the key before, length of the rest, rest of the key,
          varint number of ids, ids (little-endian, 2 or 4 bytes each)
  index   for each block: first key, place, deflated size, documents, ids before it in the shard
  bloom   a bit array, k places for each key
  footer  fixed size: places and sizes of index and Bloom filter, documents, ids, id width, checksum

A key is the id as 8 big-endian bytes with its sign bit turned, so byte order is numeric order; a
null id is the empty key and comes first. Lookups ask the Bloom filter, bisect the index and read
one block. Tasks write under a name of their own and then rename, so a repeated or speculative
task leaves one whole shard. The driver keeps one row for each shard (name, documents, ids).

Defined results: null text has the end id only; documents that repeat an id are all kept, in order
of their text; an empty table gives no shards. Files go through pyarrow's file systems.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, shared_dir
from .segments import SegmentEncoder, blanks, by_lines, by_text, chunks, distinct

MAGIC, FOOTER, BLOCK = b"QSST1\n", "<QQQQQQIII6s", 1 << 16
BLOOM_BITS, BLOOM_PLACES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            return n, i


def bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([(zlib.crc32(k), zlib.crc32(k, 0x5BD1E995) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return ((h[:, :1] + np.arange(BLOOM_PLACES, dtype=np.uint64) * h[:, 1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(bits)


class Writer:
    """Writes one shard to a binary stream; documents come in key order."""

    def __init__(self, out, width: int = 2):
        self.out, self.width = out, width
        self.place = self.docs = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self._begin()
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.place += len(b)

    def _begin(self) -> None:
        self.block, self.first, self.last, self.count, self.before = bytearray(), None, b"", 0, self.ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.first is None:
            self.first = key
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += bytes((shared, len(key) - shared)) + key[shared:] + varint(len(ids)) + ids.astype(f"<u{self.width}").tobytes()
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last, self.count, self.docs, self.ids = key, self.count + 1, self.docs + 1, self.ids + len(ids)
        if len(self.block) >= BLOCK:
            self._end()

    def _end(self) -> None:
        packed = zlib.compress(self.block, 1)
        self.index.append((self.first, self.place, len(packed), self.count, self.before))
        self._put(packed)
        self._begin()

    def close(self) -> None:
        if self.count:
            self._end()
        index = b"".join(bytes((len(k),)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        index_at = self.place
        self._put(index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        if self.keys:
            bloom[bloom_places(self.keys, bits).ravel()] = True
        bloom_at, packed = self.place, np.packbits(bloom).tobytes()
        self._put(packed)
        self._put(struct.pack(FOOTER, index_at, len(index), bloom_at, bits, self.docs, self.ids, self.width, zlib.crc32(index), zlib.crc32(packed), MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, file):
        self.file = file
        n = struct.calcsize(FOOTER)
        file.seek(file.size() - n)
        index_at, size, bloom_at, self.bits, self.docs, self.ids, self.width, index_crc, bloom_crc, magic = struct.unpack(FOOTER, file.read(n))
        file.seek(index_at)
        raw = file.read(size)
        file.seek(bloom_at)
        bloom = file.read((self.bits + 7) // 8)
        if magic != MAGIC or zlib.crc32(raw) != index_crc or zlib.crc32(bloom) != bloom_crc:
            raise ValueError("damaged shard")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8))
        self.index, i = [], 0
        while i < len(raw):
            k = raw[i + 1 : i + 1 + raw[i]]
            i += 1 + raw[i]
            self.index.append((k, *struct.unpack_from("<QQQQ", raw, i)))
            i += 32

    def block(self, n: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """key, ids of the shard before the document, ids."""
        _, place, size, count, before = self.index[n]
        self.file.seek(place)
        b, i, key = zlib.decompress(self.file.read(size)), 0, b""
        for _ in range(count):
            shared, rest = b[i], b[i + 1]
            key = key[:shared] + b[i + 2 : i + 2 + rest]
            n_ids, i = read_varint(b, i + 2 + rest)
            yield key, before, np.frombuffer(b, f"<u{self.width}", n_ids, i)
            i, before = i + n_ids * self.width, before + n_ids

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for n in range(len(self.index)):
            for key, before, ids in self.block(n):
                yield id_of(key), before, ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id."""
        key = key_of(doc_id)
        if not self.bloom[bloom_places([key], self.bits)[0]].all():
            return []
        first = [x[0] for x in self.index]
        n, found = max(0, bisect_right(first, key) - 1), []
        while n > 0 and first[n] == key:
            n -= 1
        while n < len(self.index) and first[n] <= key:
            found += [ids for k, _, ids in self.block(n) if k == key]
            n += 1
        return found


_encoders: dict[str, tuple] = {}
#: In texts of these characters alone, the tokenizer and segment_starts agree on what is white space.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ–—‘’“”]*")


#: Bytes of ASCII letters, and of marks that end a run of letters whatever follows; the apostrophe, which begins contractions, is none.
LETTER, MARK = 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[b for b in range(128) if chr(b).isalpha()]] = LETTER
KINDS[list(b".,;:!?)")] = MARK


def segment_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where segments begin in the bytes of texts that begin at `begins`: a word with the blank
    before it; of longer white space, what is left before that blank or before the last character; marks
    after an ASCII letter, so that a word is the same one before a comma. The tokenizer's pattern never joins two such segments."""
    blank = blanks(data)
    marks = np.zeros(len(data) + 1, bool)
    marks[0] = marks[begins] = True
    before = np.concatenate([[False], blank[:-1]])
    before[begins[begins < len(data)]] = False
    marks[:-1] |= blank & ~before  # white space begins
    word = np.flatnonzero(~blank & before)  # a word after white space
    marks[word - 1] = True
    marks[word[data[word - 1] != 32]] = True
    kind = KINDS[data]
    marks[1:-1] |= (kind[1:] == MARK) & (kind[:-1] == LETTER)
    return np.flatnonzero(marks[:-1])


def encoder(path: str):
    """texts -> flat ids and their number for each text, as the tokenizers library gives them."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        library = lambda texts: [e.ids for e in fast(texts, add_special_tokens=False)]
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        known = SegmentEncoder(by_lines(library), 1_000_000, 8_000_000)

        def by_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = [t.encode() for t in texts]
            data, ends = b"".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            starts = segment_starts(np.frombuffer(data, np.uint8), ends[:-1]) if data else np.empty(0, np.int64)
            ids, sizes = known(*distinct(data, starts))
            return ids, by_text(sizes, starts, ends)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            plain = [PLAIN.fullmatch(t) is not None and not any(a in t for a in added) for t in texts]
            if all(plain):
                return by_words(texts)
            ids, sizes = by_words([t for t, p in zip(texts, plain, strict=True) if p])
            whole, parts = iter(library([t for t, p in zip(texts, plain, strict=True) if not p])), iter(np.split(ids, np.cumsum(sizes)[:-1]))
            each = [next(parts) if p else np.array(next(whole), np.int32) for p in plain]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

        _encoders[path] = encode
    return _encoders[path]


def shard_name(n: int) -> str:
    return f"shard-{n:06d}.sst"


def write_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, vocabulary: int = 1 << 16, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Encode and write docs; shard number, documents and ids of each shard, in key order."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(out_dir)
        encode, writer = encoder(tokenizer_path), None
        name = f"{root}/{shard_name(task.partitionId())}"
        for b in batches:
            texts, keys = b.column("text").to_pylist(), b.column("id").to_pylist()
            for s in chunks(texts, 1 << 21):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.{task.taskAttemptId()}")
                    writer = Writer(out, width)
                ids, sizes = encode(texts[s])
                ends = np.cumsum(sizes)
                for key, a, z in zip(keys[s], (ends - sizes).tolist(), ends.tolist(), strict=True):
                    writer.add(key, np.append(ids[a:z], end_id))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([writer.docs]), pa.array([writer.ids])], names=["shard", "docs", "ids"])

    return sorted(tuple(r) for r in rows.mapInArrow(run, "shard long, docs long, ids long").collect())  # a row for each shard


def read_shards(spark: SparkSession, out_dir: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards; a task for each shard."""
    starts, total = {}, 0
    for n, (shard, _, ids) in enumerate(manifest):
        starts[n] = (shard, total)
        total += ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for b in batches:
            for n in b.column("id").to_pylist():
                shard, base = starts[n]
                with fs.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    rows = [(key, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, before, ids in Reader(file).scan()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(out_dir: str, manifest: list[tuple[int, int, int]], doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id, from the files."""
    fs, root = pafs.FileSystem.from_uri(out_dir)
    found = []
    for shard, _, _ in manifest:
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as file:
            found += [ids.tolist() for ids in Reader(file).get(doc_id)]
    return found


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = shared_dir(spark, "sstable")
    if ":" not in out_dir:
        out_dir = f"file://{out_dir}"
    manifest = write_shards(documents(spark, sf_dir), out_dir, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, out_dir, manifest)
