"""Quality rules with adaptive thresholds from mergeable quantile sketches.

One pass over the texts gives counts for each document. Ratios of them, and the numbers of words and
lines, go into logarithmic histogram sketches, one for each metric and (language, source): bucket b
holds the values in (g^(b-1), g^b], so a quantile has a relative error of at most (g - 1) / 2,
sketches merge by adding their counts in any order, and a sketch has a fixed number of buckets at
most. The fence of a metric is

  q75 + k * max(q75 - q25, unit)

where unit is what one more item (symbol, repeated line, repeated window) adds in the group's median
document; no cutoff is fixed. Quantiles of a group of n documents are drawn towards those of the
merged sketches of its language, and these towards all documents, with weight n / (n + PRIOR_DOCS),
so small groups borrow from large ones and no size is a switch. Documents meet the fences of their
group in a join, one row for each group.

Defined results: null text has no words; null language and null source are groups of their own; a
document without words fails the base rule; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lean, stage

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"

#: Sketch: relative width of a bucket, and values that count as the smallest.
GROWTH, SMALLEST = 1.02, 1e-4
#: Documents of the next level that count as much as a group's own.
PRIOR_DOCS = 50
#: metric -> (k of the fence, items in a unit, the sketch whose median is the size of a document).
UPPER = {"symbol_ratio": (6.0, 1.0, "n_words"), "dup_line_ratio": (8.0, 1.0, "n_lines"), "repeat_ratio": (10.0, float(WINDOW), "n_words"), "mean_chars": (5.0, 0.0, "n_words")}
SIZES = ("n_words", "n_lines")


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the list has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    # Pairs of equal windows are told apart exactly: ranks of halves, doubled three times.
    width = 1
    while width < WINDOW:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by=("lang", "source")) -> DataFrame:
    """id, the by columns and the counts of each document."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"by{i}") for i, c in enumerate(by)], F.col(text_col).alias("text"))
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text") + ", " + COUNTS
    names = [x.split()[0] for x in COUNTS.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([text_counts(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(got[:, i]) for i in range(len(names))], names=kept + names)

    return rows.mapInArrow(run, schema)


def _metrics(counts: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.withColumns({"symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / words, "mean_chars": F.col("word_chars") / words})


def sketch(counts: DataFrame, by=("by0", "by1")) -> DataFrame:
    """by, metric, bucket, n: the sketches of each group; add up n to merge them."""
    rows = _metrics(counts).where("n_words > 0").select(*by, F.explode(F.create_map(*[x for m in (*UPPER, *SIZES) for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    bucket = F.when(F.col("value") <= SMALLEST, F.lit(int(np.floor(np.log(SMALLEST) / np.log(GROWTH))))).otherwise(F.ceil(F.log("value") / F.lit(float(np.log(GROWTH))))).cast("int")
    return rows.groupBy(*by, "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], qs=(0.25, 0.75)) -> DataFrame:
    """keys, metric, docs, q0, q1, ...: quantiles of merged sketches, the middle of their bucket."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric").orderBy("bucket")
    merged = merged.withColumns({"upto": F.sum("n").over(w), "docs": F.sum("n").over(Window.partitionBy(*keys, "metric"))})
    middle = lambda b: F.when(b <= int(np.floor(np.log(SMALLEST) / np.log(GROWTH))), 0.0).otherwise(2 * F.pow(F.lit(GROWTH), b) / (GROWTH + 1))
    at = [F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("bucket"))) for q in qs]
    return merged.groupBy(*keys, "metric").agg(F.first("docs").alias("docs"), *[middle(a).alias(f"q{i}") for i, a in enumerate(at)])


def fences(sketches: DataFrame, prior_docs: float = PRIOR_DOCS) -> DataFrame:
    """by0, by1 and an upper fence for each metric."""
    names = ("q0", "q1", "q2")
    levels = [quantiles(sketches, keys, (0.25, 0.75, 0.5)).select(*[F.col(c).alias(f"{c}_{i}") for c in keys], F.col("metric").alias(f"metric_{i}"), F.col("docs").alias(f"docs_{i}"), *[F.col(q).alias(f"{q}_{i}") for q in names]) for i, keys in enumerate((["by0", "by1"], ["by0"], []))]
    fine, lang, every = levels
    out = fine.join(lang, F.col("by0_0").eqNullSafe(F.col("by0_1")) & (F.col("metric_0") == F.col("metric_1"))).join(every, F.col("metric_0") == F.col("metric_2"))
    own, wide = F.col("docs_0") / (F.col("docs_0") + prior_docs), F.col("docs_1") / (F.col("docs_1") + prior_docs)
    drawn = {q: own * F.col(f"{q}_0") + (1 - own) * (wide * F.col(f"{q}_1") + (1 - wide) * F.col(f"{q}_2")) for q in names}
    at = lambda q, m: F.max(F.when(F.col("metric_0") == m, drawn[q]))
    groups = out.groupBy(F.col("by0_0").alias("f0"), F.col("by1_0").alias("f1")).agg(
        *[at(q, m).alias(f"{q}_{m}") for m in UPPER for q in ("q0", "q1")], *[at("q2", m).alias(f"median_{m}") for m in SIZES])
    spread = lambda m, items, size: F.greatest(F.col(f"q1_{m}") - F.col(f"q0_{m}"), items / F.greatest(F.col(f"median_{size}"), F.lit(1.0)))
    return groups.select("f0", "f1", *[(F.col(f"q1_{m}") + k * spread(m, items, size)).alias(f"max_{m}") for m, (k, items, size) in UPPER.items()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by=("lang", "source")) -> DataFrame:
    """id, counts, base_failed, kept and the fences met, for each row of docs."""
    counts = stage(measure(docs, id_col, text_col, by), "quality-counts")
    limits = stage(fences(sketch(counts)), "quality-fences")
    rows = _metrics(counts).join(limits, F.col("by0").eqNullSafe(F.col("f0")) & F.col("by1").eqNullSafe(F.col("f1")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = F.lit(False)
    for m in UPPER:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
