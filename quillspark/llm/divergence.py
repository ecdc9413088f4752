"""Source divergence audit: how far the term frequencies of two sources of a language lie apart.

Terms are runs of ASCII letters and of characters beyond ASCII, with only A-Z lower-cased. One pass
over the texts counts terms in the tasks; a language keeps the terms that enough of its documents
hold. Each (language, source) group gives each kept term the share
p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), and two shares lie floor((p - q)^2 / (p + q)) apart.

Kept terms are dealt by hash to vocabulary chunks of about CHUNK terms and numbered within; the
counts of a group in a chunk are packed into one row (places and counts). Groups of a language form
blocks of BLOCK, and each packed row is copied to the tiles (block by block) of its language. A task
streams the sorted rows of a tile, spreads one chunk at a time into two small matrices, and adds the
chunk to the tile's submatrix of pairs, so its memory is that of two blocks of one chunk. A tile is
cut into spans of SPAN successive chunks, whose submatrices are summed, so that a large vocabulary
with few sources still makes many tasks.

All arithmetic is exact in 64-bit integers: a share takes its nine digits in three divisions, which is
exact for counts under 9e15.

Defined results: null text, language and source are ''; each row is a document, so rows that repeat
count again; a group without terms has all counts 0; a language without kept terms gives pairs of value 0;
the only source of a language has no pairs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lean, small_batches, stage

#: Fixed values of the contract.
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: Bytes that end a term become blanks; the rest stay, A-Z lower-cased.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
#: Groups of a block, terms of a chunk, chunks of a span.
BLOCK, CHUNK, SPAN = 16, 4096, 16
#: (group, term) counts that a task holds before it hands them on.
HELD = 1 << 19


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), once for each group and term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = small_batches(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text")))

    def batch(held: dict) -> pa.RecordBatch:
        flat = [(lang, source, t, c, within[t]) for (lang, source), (n, within) in held.items() for t, c in n.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, t in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                n, within = held.setdefault((lang, source), (Counter(), Counter()))
                before, words = len(n), terms(t.as_py())
                n.update(words)
                within.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield batch(held)
                    held, size = {}, 0
        if size:
            yield batch(held)

    got = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    # Dealt by (lang, term), so that the sums by group here and by language later need no other shuffle.
    return got.repartition(F.col("lang"), F.col("term")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Of terms in at least least_docs documents of their language: lang, source, term, n, total (n in
    the language) and first (true for one source of each term)."""
    whole = Window.partitionBy("lang", "term")
    rows = counts.select("*", F.sum("docs").over(whole).alias("within"), F.sum("n").over(whole).alias("total"), (F.row_number().over(whole.orderBy("source")) == 1).alias("first"))
    return rows.where(F.col("within") >= least_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "first")


def share(n: Column, of: Column) -> Column:
    """1 + floor(SCALE * n / of), exactly, by three digits at a time; n <= of."""
    digits, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + F.call_function("div", rest, of), rest % of
    return digits + 1


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The same in numpy; of has one entry for each row of n."""
    digits, rest, of = np.zeros_like(n), n, of[:, None]
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // of, rest % of
    return digits + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Tile:
    """The pair submatrix of two blocks of groups, over one chunk after another."""

    def __init__(self, key: tuple, block: int):
        self.key, self.one = key, key[1] == key[2]
        self.of = np.zeros((2, block), np.int64)
        self.here = np.zeros((2, block), bool)
        self.sums = np.zeros((block, block), np.int64)
        self.chunk, self.counts = -1, None

    def header(self, side: int, group: int, of: int) -> None:
        self.of[side, group], self.here[side, group] = of, True

    def take(self, chunk: int, width: int, side: int, group: int, places: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.add()
            self.chunk, self.counts = chunk, np.zeros((2, len(self.sums), width), np.int64)
        self.counts[side, group, places] = n

    def add(self) -> None:
        if self.counts is None:
            return
        p = [shares(self.counts[side][self.here[side]] + 2, self.of[side][self.here[side]]) for side in (range(1) if self.one else range(2))]
        right = np.flatnonzero(self.here[0 if self.one else 1])
        for i, own in zip(np.flatnonzero(self.here[0]), p[0], strict=True):
            self.sums[i, right] += apart(own, p[-1]).sum(1)
        self.counts = None

    def rows(self) -> pa.RecordBatch:
        """lang, item and other group, value: both directions of each pair."""
        self.add()
        lang, bi, bj, _ = self.key
        block = len(self.sums)
        i, j = np.nonzero(self.here[0][:, None] & self.here[0 if self.one else 1][None, :])
        value, a, b = self.sums[i, j], bi * block + i, bj * block + j
        if not self.one:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        off = a != b
        return pa.RecordBatch.from_arrays([pa.array([lang] * int(off.sum()), pa.string()), pa.array(a[off]), pa.array(b[off]), pa.array(value[off])], names=["lang", "a", "b", "value"])


TILE = ["lang", "bi", "bj", "span"]


def tiled(records: DataFrame, block: int) -> DataFrame:
    """lang, a, b, value of each pair of groups (by number) and span."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in TILE), strict=True)
            chunk, side, group, of, width = (b.column(c).to_pylist() for c in ("chunk", "side", "grp", "of", "width"))
            lists = b.column("packed")
            ends, flat = lists.offsets.to_numpy(), lists.values
            places, n = flat.field("place").to_numpy(), flat.field("n").to_numpy()
            for r, key in enumerate(keys):
                if tile is None or tile.key != key:
                    if tile is not None:
                        yield tile.rows()
                    tile = Tile(key, block)
                if chunk[r] < 0:
                    tile.header(side[r], group[r], of[r])
                else:
                    at = slice(ends[r], ends[r + 1])
                    tile.take(chunk[r], width[r], side[r], group[r], places[at], n[at])
        if tile is not None:
            yield tile.rows()

    order = [*TILE, "chunk", "side", "grp"]
    return records.repartition(*TILE).sortWithinPartitions(*order).mapInArrow(run, "lang string, a long, b long, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the top terms in
    which a source exceeds its language."""
    kept = stage(kept_counts(term_counts(docs, lang_col, source_col, text_col), least_docs), "divergence-counts")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = stage(kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("v")), "divergence-langs")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    here = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    groups = stage(groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", number.cast("long").alias("number"), (zero("size") + 2 * zero("v")).alias("of"), (zero("lang_size") + 2 * zero("v")).alias("lang_of"),
        F.ceil(F.count(F.lit(1)).over(here) / block).cast("int").alias("blocks"), F.ceil(zero("v") / chunk).cast("int").alias("chunks")), "divergence-groups")

    counted = kept.join(groups, ["lang", "source"])
    vocabulary = kept.where("first").join(langs, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / chunk)).cast("int").alias("chunk"))
    inside = Window.partitionBy("lang", "chunk")
    vocabulary = vocabulary.select("lang", "term", "chunk", (F.row_number().over(inside.orderBy("term")) - 1).alias("place"), F.count(F.lit(1)).over(inside).cast("int").alias("width"))
    vectors = counted.join(vocabulary, ["lang", "term"]).groupBy("lang", "number", "blocks", "chunk", "width").agg(F.collect_list(F.struct("place", "n")).alias("packed"))
    none = F.array().cast(vectors.schema["packed"].dataType)
    # Terms that neither block holds set groups apart too, so each block has a row in each chunk.
    blocks = groups.where(F.col("number") % block == 0).select("lang", "number", "blocks")
    silent = vocabulary.select("lang", "chunk", "width").distinct().join(blocks, "lang").select("lang", "number", "blocks", "chunk", "width", none.alias("packed"))
    vectors = vectors.unionByName(silent)
    headers = groups.select("lang", "number", "blocks", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("chunks") / span).cast("int") - 1))).alias("span"), F.lit(-1).alias("chunk"), F.lit(0).alias("width"), "of", none.alias("packed"))
    records = headers.unionByName(vectors.select("lang", "number", "blocks", F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "width", F.lit(0).cast("long").alias("of"), "packed"))
    own = F.floor(F.col("number") / block).cast("int")
    records = records.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", F.least(own, "other").alias("bi"), F.greatest(own, "other").alias("bj"), "span", "chunk", F.when(own > F.col("other"), 1).otherwise(0).alias("side"),
        (F.col("number") % block).cast("int").alias("grp"), "of", "width", "packed")

    names = groups.select("lang", F.col("number").alias("a"), "source")
    sums = tiled(records, block).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share(F.col("n") + 2, F.col("of")), share(F.col("total") + 2, F.col("lang_of"))
    found = counted.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_group).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(found, "term").where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM vocab GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM w JOIN vocab USING (lang, term) GROUP BY ALL),
gsize AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, vocab.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(gsize.n, 0) + 2 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (total + 2)) // (sizes.n + 2 * v)::HUGEINT AS q
      FROM grp g JOIN vocab ON g.lang = vocab.lang JOIN sizes ON g.lang = sizes.lang
      LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = vocab.term LEFT JOIN gsize ON gsize.lang = g.lang AND gsize.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 10
"""
