"""Periodic runs of words, found for all lags by bit-parallel comparison.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least max(least, copies * q) words, that no neighbouring word extends keeping period q. The words of
a text get numbers; plane b is one big integer with bit i set where the number of word i has bit b.
For a lag q the XOR of each plane with itself shifted by q, ORed over the planes, has a zero bit where
words i and i + q are equal; a run of length L is a stretch of L - q zeros. The complement is ANDed
with itself shifted by 1, 2, 4, ... until only the starts of long enough stretches are left. An AND
that leaves nothing ends the lag, and so does a plane after which no stretch is long enough: the
planes not yet seen could only shorten it. So most lags cost a few operations over n bits.

A stretch at lag q whose smallest period p is less is the very run of p, as p then divides q; it was
seen at lag p and is left out.

Time is n / 3 lags of n bits each at worst; memory is n bits for each of log2(n) planes.

Defined results: null and empty texts have no words and no runs; each row stands for itself, so rows
that repeat get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, lean, small_batches

#: A run has at least LEAST words and COPIES times its period.
LEAST, COPIES = 24, 3
#: Planes that are compared before stretches are looked for the first time.
FIRST_PLANES = 2

#: start, length, period.
Run = tuple[int, int, int]


def planes(words: list[bytes]) -> list[int]:
    """The bit planes of the numbers of the words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range((len(seen) - 1).bit_length())]


def long_stretches(ones: int, least: int) -> int:
    """Bits from which `least` ones follow each other in `ones`, by shift-doubling AND."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def places(bits: int) -> np.ndarray:
    """The indices of the bits set."""
    raw = bits.to_bytes((bits.bit_length() + 7) // 8, "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))


def runs(words: list[bytes], least: int = LEAST, copies: int = COPIES) -> list[Run]:
    """All runs, by start, then period."""
    n = len(words)
    if n < max(least, copies):
        return []
    bits, found, taken = planes(words), [], set()
    full = (1 << n) - 1
    for q in range(1, n // copies + 1):
        need = max(least, copies * q) - q
        inside, apart, starts = full >> q, 0, 0
        for b, plane in enumerate(bits):
            apart |= plane ^ plane >> q
            if b + 1 >= FIRST_PLANES and not (starts := long_stretches(~apart & inside, need)):
                break
        else:
            starts = long_stretches(~apart & inside, need)
        if starts:
            for s, e in zip(places(starts & ~(starts << 1)).tolist(), places(starts & ~(starts >> 1)).tolist(), strict=True):
                length = e - s + need + q
                if (s, length) not in taken:
                    taken.add((s, length))
                    found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """id, runs (by start, then period) and collapsed (the words kept, joined by one space) of each row.

    rewrite, if given, takes the id and the words and returns the words to look at."""
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            out, texts = [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                words = (t.as_py() or "").encode().split()
                words = rewrite(i, words) if rewrite else words
                found = runs(words, least, copies)
                out.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind), pa.array(texts, pa.string())], names=["id", "runs", "collapsed"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL("runs array<struct<start:long,length:long,period:long>>, collapsed string").fields]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: of one document in ten, by id, the words from a on repeat with period p."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def query(spark, sf_dir: str) -> DataFrame:
    """One row for each document; a null id repeats nothing."""
    found = find_runs(documents(spark, sf_dir), rewrite=planted)
    # Of the runs by start, then period, the first of greatest length / period: exact by cross products.
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", best)
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), hexed(listed).alias("runs_sha256"), hexed(F.col("collapsed")).alias("collapsed_sha256"))
