"""Language identification as multilingual mixture inference.

Training counts letter trigrams by language over all labelled training documents: each task sums
its own counts, Spark adds them up, and the model is a fixed table of hashed trigram buckets by
language. The number of buckets is a parameter, so the table has buckets x languages entries,
whatever the size of the corpus; more than `most_languages` languages raise an error instead of
growing it.

A document is a mixture: each word comes from one language with the probability of its trigrams.
Expectation-maximisation estimates the proportions of all languages; the language set is the one of
the k most frequent with the best likelihood less (k - 1) / 2 * log(words). Documents are handled
in chunks of bounded size, vectorised over all their words.

Defined results: null text and text without letters give "und" with score 0; without any training
document every text gives "und"; documents with a null id are never trained on and count as held
out; rows that repeat are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, lean, packed, small_batches, stage, unpacked
from .segments import chunks

BUCKETS, MOST_LANGUAGES, CHUNK_CHARS = 1 << 16, 256, 1 << 19
SMOOTHING, STEPS = 0.05, 12

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: the bucket of the trigram around each letter, the index of its first
    gram for each word, and the number of words of each text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets)
    first = np.flatnonzero(~is_letter[at - 1])
    ends = 1 + np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    upto = np.searchsorted(at[first], ends - 1) if len(first) else np.zeros(len(texts), np.int64)
    return h.astype(np.int64), first, np.diff(np.concatenate([[0], upto]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log probabilities of shape (buckets, languages)."""
    rows = small_batches(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
            for lang in set(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for s in chunks(own, CHUNK_CHARS):
                    got = np.bincount(grams(own[s], buckets)[0], minlength=buckets)
                    sums[lang] = sums[lang] + got if lang in sums else got
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage(counts, "lang-counts")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(most_languages + 1).collect())
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang_col}")
    got = counts.toArrow()  # buckets * languages cells at most
    table = np.full((buckets, len(names)), SMOOTHING)
    column = got.column("lang").to_numpy(zero_copy_only=False) if got.num_rows else np.empty(0, object)
    place = np.searchsorted(np.array(names, dtype=object), column) if names else np.empty(0, np.int64)
    table[got.column("bucket").to_numpy(), place] += got.column("n").to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32)


def mixtures(words: np.ndarray, first: np.ndarray, doc: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over documents at once. words: likelihoods (words, languages), largest 1; first: index of
    its first word for each document; doc: the document of each word; pi: the proportions to begin
    with, 0 where a language is out. Returns proportions and log likelihoods."""
    n = np.diff(np.append(first, len(words)))[:, None]
    for _ in range(steps):
        r = words * pi[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first) / n
    return pi, np.add.reduceat(np.log((words * pi[doc]).sum(1)), first)


def infer(texts: list[str], table: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: proportions of all languages (0 where it has no letter), and of the chosen set,
    and the size of that set."""
    n_langs = table.shape[1]
    h, first, per_doc = grams(texts, table.shape[0])
    out, chosen, sizes = np.zeros((len(texts), n_langs)), np.zeros((len(texts), n_langs)), np.zeros(len(texts), int)
    live = np.flatnonzero(per_doc)
    if not n_langs or not len(live):
        return out, chosen, sizes
    ll = np.add.reduceat(table[h], first).astype(np.float64)
    words = np.exp(ll - ll.max(1, keepdims=True))
    words = np.maximum(words, 1e-30)
    counts = per_doc[live]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(live)), counts)
    pi, whole = mixtures(words, starts, doc, np.full((len(live), n_langs), 1 / n_langs), steps)
    order = np.argsort(-pi, axis=1, kind="stable")
    logs = np.log(words)
    single = np.take_along_axis(np.add.reduceat(logs, starts), order[:, :1], 1)[:, 0]
    penalty = 0.5 * np.log(np.maximum(counts, 2))
    best, size, mix = single.copy(), np.ones(len(live), int), np.zeros_like(pi)
    np.put_along_axis(mix, order[:, :1], 1.0, 1)
    for k in range(2, n_langs + 1):
        # No set beats the likelihood of all languages together by more than rounding.
        open_docs = np.flatnonzero(whole + 1e-6 * np.abs(whole) + 0.5 - penalty * (k - 1) > best)
        if not len(open_docs):
            break
        take = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in open_docs])
        begin = np.zeros((len(open_docs), n_langs))
        np.put_along_axis(begin, order[open_docs, :k], np.take_along_axis(pi[open_docs], order[open_docs, :k], 1) + 1e-3, 1)
        begin /= begin.sum(1, keepdims=True)
        at = np.concatenate([[0], np.cumsum(counts[open_docs])[:-1]])
        p, v = mixtures(words[take], at, np.repeat(np.arange(len(open_docs)), counts[open_docs]), begin, steps)
        v -= penalty[open_docs] * (k - 1)
        better = v > best[open_docs]
        best[open_docs[better]], size[open_docs[better]], mix[open_docs[better]] = v[better], k, p[better]
    out[live], chosen[live], sizes[live] = pi, mix, size
    return out, chosen, sizes


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, text_col: str = "text", keep: list[str] | None = None, within: str | None = None) -> DataFrame:
    """The kept columns with lang_pred, score (its proportion), share (that in the chosen set), n_langs
    and langs (the set). Kept columns must have other names. The text is a column, or, with `within`, a field of that kept struct column."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    rows = small_batches(docs.select(*keep, *([] if within else [F.col(text_col).alias("_text")])))
    model = spark.sparkContext.broadcast(table)
    new = StructType.fromDDL("lang_pred string, score double, share double, n_langs int, langs array<string>")
    schema = StructType([*(f for f in rows.schema.fields if f.name in keep), *new.fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        names = np.array([*langs, "und"], object)
        for b in batches:
            texts = (b.column(within).field(text_col) if within else b.column("_text")).to_pylist()
            for s in chunks(texts, max(1 << 16, CHUNK_CHARS * 4 // max(4, len(langs)))):
                own = [t or "" for t in texts[s]]
                pi, mix, size = infer(own, table)
                top = np.where(size > 0, mix.argmax(1) if len(langs) else 0, len(langs))
                score = np.where(size > 0, pi[np.arange(len(own)), np.minimum(top, len(langs) - 1)] if len(langs) else 0.0, 0.0)
                share = np.where(size > 0, mix.max(1) if len(langs) else 0.0, 0.0)
                sets = [[langs[j] for j in np.argsort(-m, kind="stable")[:k]] for m, k in zip(mix, size, strict=True)]
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(names[top].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(share), pa.array(size.astype(np.int32)), pa.array(sets, pa.list_(pa.string()))],
                    names=[*keep, *new.names])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id"))
    langs, table = train(docs.where(~F.col("held_out")))
    return predict(docs, langs, table, keep=["doc_id", "held_out"])


#: The stage rejects documents without a language and those in whose chosen set no language has this
#: share: sets of five languages and more, with no main one.
LEAST_SHARE = 0.21


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a main language; the columns of docs, under any name.

    Defined results: documents with null text or without a letter go, and those of more languages
    than LEAST_SHARE allows; short and mixed ones stay; rows that repeat are judged alike; if there is nothing to learn from, all
    go, as no language is known; an empty table gives none."""
    langs, table = train(docs.where(~held_out("doc_id")))
    judged = predict(packed(docs), langs, table, keep=["row"], within="row")
    return unpacked(judged.where((F.col("lang_pred") != "und") & (F.col("share") >= LEAST_SHARE)), docs.columns)
