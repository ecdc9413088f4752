"""Toxicity by a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A feature is a run of GRAM code points inside a lower-cased run of letters with a blank at each end (a
shorter one is one gram); a text has or has not a feature, however long it is. One pass over all labelled
training texts counts for each gram the texts of both classes that hold it, and

  r = log((n1 + 1) / (D1 + 2)) - log((n0 + 1) / (D0 + 2))

is its log-count ratio; D1 and D0 are the texts of each class. The FEATURES grams whose r is furthest from 0 in
units of its standard error sqrt(1 / (n1 + 1) + 1 / (n0 + 1)), LEAST_ERRORS units at least, are kept.
The value of feature j in a text is r_j where it is present. A logistic regression with squared
penalty is fitted on these values by Newton steps with conjugate gradients, on at most FIT_ROWS labelled
texts, those with the smallest hash of their id (a bounded sample, documented here; counts and ratios cover all).

Scoring hashes the grams of whole texts and meets the kept ones by exact 64-bit hashes.

Defined results: null and empty texts have no feature and score by the intercept alone; a document
with several labels is toxic if one of them is 1, labels other than 0 and 1 and null ones are left out; null ids are
never trained on and count as held out; with no training text of one of the classes the score is the
share of toxic texts after adding one of each class; rows that repeat are treated alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, lean, small_batches, stage
from .langid import letters
from .segments import chunks, mix

GRAM, FEATURES, LEAST_ERRORS, FIT_ROWS = 5, 2048, 4.0, 10_000
PENALTY, STEPS = 1.0, 30
CHUNK_CHARS = 1 << 19
#: Distinct grams that a task holds before it hands their counts on.
HELD = 1 << 20


def grams(texts: list[str], size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts together: the 64-bit hash of each gram, and where the grams of each text end."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} \n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 3 for t in lowered), np.int64, len(lowered)))
    blank = ~letters()[codes]
    c = np.where(blank, 0, codes).astype(np.uint64)  # all blanks are one
    # A gram begins at each character of a word and at the blank before it, and ends at the next blank at most.
    begin = np.flatnonzero(~blank[:-1] | ~blank[1:])
    stop = np.flatnonzero(blank)
    word_end = stop[np.searchsorted(stop, begin + 1)]
    full = begin + size - 1 <= word_end
    whole = blank[begin] & ~full  # a word too short for one gram
    begin, word_end = begin[full | whole], word_end[full | whole]
    h = np.zeros(len(begin), np.uint64)
    for k in range(size):
        here = np.minimum(begin + k, word_end + 1)
        h = mix(h + np.where(here <= word_end, c[np.minimum(here, word_end)] + np.uint64(1), np.uint64(0)) + np.uint64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(begin, ends)


def of_each(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text."""
    return [np.unique(h[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


def gram_counts(rows: DataFrame, size: int = GRAM) -> DataFrame:
    """gram, n1, n0 over rows of text and label (1 or 0)."""
    rows = small_batches(rows.select("text", F.col("label").cast("int").alias("label")))

    def batch(held: list) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        label = np.repeat([y for _, y in held], [len(g) for g, _ in held])
        n1 = np.bincount(at, label, len(keys)).astype(np.int64)
        n = np.bincount(at, minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["gram", "n1", "n0"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            texts, labels = [t or "" for t in b.column("text").to_pylist()], b.column("label").to_pylist()
            for s in chunks(texts, CHUNK_CHARS):
                for g, y in zip(of_each(*grams(texts[s], size)), labels[s], strict=True):
                    held.append((g, y))
                    count += len(g)
                if count > 4 * HELD:
                    yield batch(held)
                    held, count = [], 0
        if held:
            yield batch(held)

    return rows.mapInArrow(run, "gram long, n1 long, n0 long").groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def ratio(n1: Column, n0: Column, d1: int, d0: int) -> Column:
    return F.log((n1 + 1) / (d1 + 2)) - F.log((n0 + 1) / (d0 + 2))


def select(counts: DataFrame, d1: int, d0: int, features: int = FEATURES, least: float = LEAST_ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the kept grams, and their ratios."""
    r = ratio(F.col("n1"), F.col("n0"), d1, d0)
    units = F.abs(r) / F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    best = counts.select("gram", r.alias("r"), units.alias("units")).where(F.col("units") >= least).orderBy(F.desc("units"), "gram").limit(features)
    got = best.toArrow()  # `features` rows at most
    keys = got.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("r").to_numpy()[order]


class Present:
    """Which kept grams a text holds. Low bits of the hashes sort out most grams; exact hashes decide."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.bits = keys, np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(keys & self.bits).astype(np.int64)] = True

    def __call__(self, texts: list[str], size: int = GRAM) -> list[np.ndarray]:
        """For each text the indices of its kept grams, ascending."""
        h, ends = grams(texts, size)
        near = np.flatnonzero(self.maybe[(h & self.bits).astype(np.int64)])
        if not len(self.keys) or not len(near):
            return [np.empty(0, np.int64)] * len(texts)
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        hit = self.keys[at] == h[near]
        near, at = near[hit], at[hit]
        cut = np.searchsorted(near, ends)
        return of_each(at, cut)


def fit(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression over the values r of the features that each row
    holds; Newton steps, each solved by conjugate gradients, halved while they do not improve."""
    y = labels.astype(np.float64)
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = r[col]
    k = len(r)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[col], len(y)) + w[k]

    def backward(e: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, value * e[row], k), e.sum())

    held = np.append(np.full(k, penalty), 1e-6)

    def loss(w: np.ndarray) -> float:
        z = forward(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (held * w * w).sum())

    w = np.zeros(k + 1)
    w[k] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -500, 500)))
        g = backward(p - y) + held * w
        curve = p * (1 - p)
        step, rest = np.zeros(k + 1), -g
        d, size = rest.copy(), rest @ rest
        for _ in range(50):
            if size <= 1e-12 * (g @ g):
                break
            hd = backward(curve * forward(d)) + held * d
            a = size / (d @ hd)
            step, rest = step + a * d, rest - a * hd
            d, size = rest + (rest @ rest) / size * d, rest @ rest
        scale = 1.0
        while scale > 1e-6 and (after := loss(w + scale * step)) > now:
            scale /= 2
        if scale <= 1e-6 or now - after <= 1e-9 * (1 + abs(now)):
            break
        w, now = w + scale * step, after
    return w[:k], float(w[k])


#: Hashes and values (ratio times weight) of the kept grams, and the intercept.
Model = tuple[np.ndarray, np.ndarray, float]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", features: int = FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """Counts over all labelled rows of docs; the regression on fit_rows of them at most."""
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Labels grow with the documents: they meet by a sort-merge join at every size.
    counts = stage(gram_counts(texts.join(marks.hint("merge"), "id")), "toxicity-counts")
    ids = stage(texts.select("id").join(marks, "id"), "toxicity-ids")
    d1, d0 = ids.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not d1 or not d0:
        return np.empty(0, np.uint64), np.empty(0), float(np.log((d1 + 1) / (d0 + 1)))
    keys, r = select(counts, d1, d0, features)
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(fit_rows).distinct()
    model = spark.sparkContext.broadcast(keys)
    rows = small_batches(texts.join(F.broadcast(chosen), "id").select("id", "text", "label"))  # fit_rows ids and labels at most

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present(model.value)
        for b in batches:
            own = [t or "" for t in b.column("text").to_pylist()]
            for s in chunks(own, CHUNK_CHARS):
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([x.tolist() for x in present(own[s])], pa.list_(pa.int32()))], names=["id", "label", "held"])

    schema = StructType([rows.schema["id"], rows.schema["label"], *StructType.fromDDL("held array<int>").fields])
    got = rows.mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "held").limit(fit_rows).toArrow()
    weights, intercept = fit([np.array(x, np.int64) for x in got.column("held").to_pylist()], got.column("label").to_numpy(), r)
    return keys, r * weights, intercept


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, which must have other names, with score."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    rows = small_batches(docs.select(*keep, F.col(text_col).alias("_text")))
    schema = StructType([*(f for f in rows.schema.fields if f.name in keep), *StructType.fromDDL("score double").fields])
    shared = spark.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, intercept = shared.value
        present = Present(keys)
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            z = np.full(len(texts), intercept)
            for s in chunks(texts, CHUNK_CHARS):
                z[s] += [values[x].sum() for x in present(texts[s])]
            out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~F.col("held_out")), labels)
    return score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
