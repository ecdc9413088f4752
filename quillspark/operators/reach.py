"""Which documents can enter the frontier of a query: matches of words counted in the tasks that read the
documents, and bounds of the score.

A task cuts a chunk of documents into words (see `scan`) and counts, for a block of queries, what the words of
each document match; the keys of a block travel to the tasks. From these counts and the numbers of a document follow bounds
between which the score lies. A task keeps the `limit` best lower bounds of each query that it has seen:
a pair whose upper bound is under the last of them has that many better ones and is left. All others are
given out, among them the best lower bounds of all tasks, so the bar that these set is that of all pairs.

Queries go in blocks of QUERIES, so what a task holds does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scan import MARKS, Scan, Words

#: Queries of a block, cells (documents times queries) that are counted at once, and bytes of text.
QUERIES, CELLS, BYTES = 2_000, 1 << 18, 1 << 23
#: More than rounding, and numbers of 32 bits, move a bound.
SLACK = 0.00005
#: Bits of a query's keys: its anchors, and for each phrase its middle word and its last.
ANCHORS, PHRASES = 3, 6
MIDDLE, LAST = ANCHORS, ANCHORS + PHRASES
BITS = LAST + PHRASES
#: Characters by which words of six letters and more meet softly.
START = 5
FOUND = (
    "query_id long, doc_id long, t_focus long, c_focus long, t_graph long, c_graph long, c_concepts long, t_bits long, c_bits long, n_t int, n_c int, "
    + ", ".join(f"{m} int" for m in MARKS) + ", low double, high double")


@dataclass
class Postings:
    """For each key the cells of a table that it counts for: query, and bit if it has some."""

    first: np.ndarray
    query: np.ndarray
    bit: np.ndarray

    @staticmethod
    def of(n_keys: int, key: np.ndarray, query: np.ndarray, bit: np.ndarray | None = None) -> Postings:
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n_keys))])
        return Postings(first, query[order], (np.zeros(len(key), np.int64) if bit is None else bit)[order])

    def hits(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, query and bit of each posting of the keys."""
        n = self.first[key + 1] - self.first[key]
        at = np.arange(int(n.sum())) + np.repeat(self.first[key] - (np.cumsum(n) - n), n)
        return np.repeat(doc, n), self.query[at], self.bit[at]


class Block:
    """The keys and numbers of some queries."""

    def __init__(self, about: pa.Table, keys: pa.Table):
        about = about.sort_by("query_id")
        self.ids = about.column("query_id").to_numpy().astype(np.int64)
        self.n = {c: about.column(f"n_{c}").to_numpy().astype(np.float32) for c in ("focus", "words", "concepts", "graph", "anchors")}
        self.most_grams = about.column("most_grams").to_numpy().astype(np.float32)
        self.named = np.array([bool(p) for p in about.column("profiles").to_pylist()])
        phrases = [(p or [])[:PHRASES] for p in about.column("phrases").to_pylist()]
        self.phrase, self.middle, self.last = np.zeros((3, len(phrases), PHRASES), bool)
        for q, of in enumerate(phrases):
            for i, p in enumerate(of):
                words = p.split(" ")
                self.phrase[q, i], self.middle[q, i], self.last[q, i] = True, len(words) >= 3, len(words[-1]) >= START
        self.values, self.postings = {}, {}
        for by in "wsc":
            own = keys.filter(pc.equal(keys.column("by"), by))
            codes = own.column("key").combine_chunks().dictionary_encode()
            self.values[by], key = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
            query = np.searchsorted(self.ids, own.column("query_id").to_numpy())
            for what in ("focus", "words", "concepts", "graph"):
                has = own.column(what).to_numpy() > 0
                self.postings[by, what] = Postings.of(len(self.values[by]), key[has], query[has])
            bits = own.column("bits").to_numpy()
            row, bit = np.nonzero(bits[:, None] >> np.arange(BITS) & 1)
            self.postings[by, "bits"] = Postings.of(len(self.values[by]), key[row], query[row], bit)


def of_words(found: Words, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of the words for which of_word, by the number of the word, has one (-1: none)."""
    n = of_word[found.code]
    return found.row[n >= 0], n[n >= 0]


def wanted(words: pa.Array, keys: pa.Array) -> np.ndarray:
    """The key that each word is, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(words: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """Which words have n characters, and the first n of each. Tokens are ASCII."""
    return pc.greater_equal(pc.binary_length(words), n).to_numpy(zero_copy_only=False), pc.utf8_slice_codeunits(words, 0, n)


def distinct_starts(found: Words, n_docs: int) -> np.ndarray:
    """How many different starts of four letters each row has: no more than its 4-grams."""
    long, first = starts(found.words, 4)
    codes = first.dictionary_encode()
    row, code = of_words(found, np.where(long, codes.indices.to_numpy(), -1))
    return Words.of(row, code, codes.dictionary).sizes(n_docs)


class Matches:
    """What the words of a chunk of documents match of a block: arrays of documents times queries."""

    def __init__(self, block: Block, found: Scan, n_docs: int):
        self.shape = (n_docs, len(block.ids))
        self.sizes, self.grams, keys, first = {}, {}, {}, {}
        for p, own in found.words.items():
            if p == "e" and own is found.words["c"]:
                self.sizes[p], self.grams[p], keys[p], first[p] = self.sizes["c"], self.grams["c"], keys["c"], first["c"]
                continue
            self.sizes[p], keys[p] = own.sizes(n_docs), of_words(own, wanted(own.words, block.values["w"]))
            long, start = starts(own.words, START)
            first[p] = of_words(own, np.where(long, wanted(start, block.values["s"]), -1))
            if p != "t":
                self.grams[p] = distinct_starts(own, n_docs)
        asked = {"t": ("focus", "words", "graph"), "c": ("focus", "words", "graph"), "e": ("words",)}
        self.counts = {(p, what): self._count(block.postings["w", what], keys[p]) for p, names in asked.items() for what in names}
        # Concepts as written: capitalised words, and long tokens.
        names = [of_words(w, wanted(w.words, block.values["c"])) for w in (found.proper, found.words["c"])]
        self.counts["c", "concepts"] = self._count(block.postings["c", "concepts"], tuple(np.concatenate(x) for x in zip(*names, strict=True)))
        self.bits = {}
        for p in found.words:
            self.bits[p] = np.zeros((BITS, *self.shape), bool)
            for by, hits in (("w", keys[p]), ("s", first[p])):
                doc, query, bit = block.postings[by, "bits"].hits(*hits)
                self.bits[p][bit, doc, query] = True

    def _count(self, postings: Postings, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        doc, query, _ = postings.hits(*found)
        return np.bincount(doc * self.shape[1] + query, minlength=self.shape[0] * self.shape[1]).reshape(self.shape).astype(np.float32)


def numbers_of(marks: dict[str, np.ndarray], distinct: np.ndarray) -> np.ndarray:
    """What a score holds of the document alone, but for rounding: definitional, authority, depth and spam."""
    least, m = np.minimum, marks
    n = m["n_title"] + m["n_tokens"]
    ratio = distinct / np.maximum(n, 1)
    definitional = least(m["defining"] * 0.11 + m["defined"] * 0.12, 1)
    depth = least(m["n_tokens"] / 280, 1) * 0.58 + least(m["sentences"] / 7, 1) * 0.22
    authority = 0.48 + (m["usable"] >= 4) * 0.05 + (m["n_title"] >= 2) * 0.03
    spam = (m["repeated"] * 0.24 + m["digits"] * 0.16 + least(m["noisy"] * 0.12, 0.24) + m["listicle"] * 0.12 + least(m["terms"] * 0.10, 0.25)
            + np.where((n >= 20) & (ratio < 0.60), least((0.60 - ratio) * 0.85, 0.28), 0) + ((m["n_tokens"] < 40) | (m["sentences"] < 2)) * 0.08)
    return definitional * 0.16 + authority * 0.13 + depth * 0.12 - least(spam, 1) * 0.18


def bounds(block: Block, m: Matches, marks: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Between what the score of each pair lies; see frontier.scores for the parts."""
    n_tokens, sentences = marks["n_tokens"], marks["sentences"]
    f32 = np.float32
    column = lambda x: np.asarray(x, f32)[:, None]
    least, most, n = np.minimum, np.maximum, block.n
    title, content = m.counts["t", "focus"] / most(n["focus"], 1), m.counts["c", "focus"] / most(n["focus"], 1)
    told = np.where(n["concepts"] > 0, m.counts["c", "concepts"] / most(n["concepts"], 1), f32(0))
    informative = np.clip(column(least(n_tokens / 260, 1) * 0.25 + least(sentences / 6, 1) * 0.15) + content * f32(0.25) + told * f32(0.20), f32(0.35), f32(0.98))  # rounding to four digits: within SLACK
    n_t, n_c, n_e = (column(m.sizes[p]) for p in "tce")
    both = (n_t > 0) & (n_c > 0)
    common = np.where(both, n_t / most(n_c, 1), f32(0))
    own = np.where(both, common, np.where((n_t > 0) | (n_c > 0), f32(0.48), f32(0)))

    def likeness(p: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words are known, and of n-grams that the larger side has more than the smaller."""
        hits = m.counts[p, "words"]
        none = (size == 0) | (n["words"] == 0)
        words = np.where(none, f32(0), hits / most(size + n["words"] - hits, 1) * f32(0.55))
        grams = least(f32(1), block.most_grams / most(column(m.grams[p]), 1)) if p in m.grams else f32(1)
        return words, np.where(none, f32(0), least(words + grams * f32(0.45), f32(1)))

    graph = (m.counts["t", "graph"] * f32(0.55) + m.counts["c", "graph"] * f32(0.45)) / most(n["graph"], 1)
    overlap = title * f32(0.46) + content * f32(0.30) + graph * f32(0.24)
    t, c, rest = m.bits["t"], m.bits["c"], n["anchors"] - 1
    shares = lambda b: b[1:ANCHORS].sum(0, dtype=f32) / most(rest, 1)
    boost = np.where(t[0], f32(0.42), np.where(c[0], f32(0.28), f32(0))) + np.where(rest > 0, shares(t) * f32(0.18) + shares(c) * f32(0.10), f32(0))
    lacking = ~t[0] & ~c[0] & (n["words"] > 3) & (overlap > 0)
    base = title * f32(0.16) + content * f32(0.08) + informative * f32(0.06) + column(numbers_of(marks, m.sizes["c"]))

    def score(like: np.ndarray, fit: np.ndarray, aligned: np.ndarray, slack: float) -> np.ndarray:
        # Near the border the absence counts as the bound needs it.
        absent = lacking & (like < f32(0.28 - np.sign(slack) * 1e-4))
        anchors = np.where(n["anchors"] > 0, boost - absent * f32(0.10), f32(0))
        r = np.clip(overlap + anchors + like * f32(0.18) + most(fit, 0) * f32(0.34) - most(-fit, 0) * f32(0.48), 0, 1)
        h = np.clip(own * f32(0.32) + (title + content) * f32(0.05) + r * f32(0.18) + aligned * f32(0.30), 0, 1)
        return most(base + r * f32(0.27) + h * f32(0.10), 0) + f32(slack)

    low, high = likeness("e", n_e)
    to_title, to_content = likeness("t", n_t)[1], likeness("c", n_c)[1]
    to_query = np.where(both, (to_title + to_content) / 2, most(to_title, to_content))
    aligned = least(f32(1), to_query * f32(0.45) + np.where(both, common * f32(0.55) + f32(0.45), f32(0)) * f32(0.40))
    e = m.bits["e"]
    met = (block.phrase[:, i] & (e[MIDDLE + i] | ~block.middle[:, i]) & (e[LAST + i] | ~block.last[:, i]) for i in range(PHRASES))
    possible = sum((x.astype(f32) for x in met), np.zeros(m.shape, f32))
    by_phrases = least(possible * f32(0.16), f32(0.32)) + np.where(possible > 0, f32(0.06), f32(0))
    return (score(low, np.where(block.named, f32(-1), f32(0)), np.zeros(1, f32), -SLACK),
            score(high, np.where(block.named, f32(1), by_phrases), aligned, SLACK))


def best_of(best: np.ndarray, query: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The best lower bounds of each query (a row, falling), with more of some queries."""
    n, limit = best.shape
    of, every = np.concatenate([np.repeat(np.arange(n), limit), query]), np.concatenate([best.ravel(), low])
    order = np.lexsort((-every, of))
    of = of[order]
    nth = np.arange(len(of)) - np.searchsorted(of, np.arange(n))[of]
    return every[order[nth < limit]].reshape(n, limit)


def portions(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows, and BYTES of text or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False).tolist()
    a = held = 0
    for z, size in enumerate(sizes):
        if z > a and (z - a >= rows or held + size > BYTES):
            yield batch.slice(a, z - a)
            a, held = z, 0
        held += size
    if a < len(sizes):
        yield batch.slice(a)


def candidates(docs: DataFrame, about: pa.Table, keys: pa.Table, limit: int, rules: tuple[str, str, list[str]]) -> DataFrame:
    """FOUND of docs(doc_id, content) and the queries of a block: the pairs with a common focus word that can be
    among the `limit` best of their query. rules: patterns of defining words and lists, and spam terms."""
    shared = docs.sparkSession.sparkContext.broadcast(Block(about, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n_queries = len(block.ids)
        best = np.full((n_queries, limit), -np.inf, np.float32)
        for batch in batches:
            for rows in portions(batch, max(1, CELLS // max(1, n_queries))):
                found = Scan(rows.column("content"), *rules)
                m = Matches(block, found, rows.num_rows)
                low, high = bounds(block, m, found.marks)
                met = m.counts["t", "focus"] + m.counts["c", "focus"] > 0
                d, q = np.nonzero(met & (low > best[:, -1]))
                best = best_of(best, q, low[d, q])
                d, q = np.nonzero(met & (high >= best[:, -1]))
                flags = lambda p: (1 << np.arange(ANCHORS)) @ m.bits[p][:ANCHORS, d, q]  # noqa: B023, E731
                whole = lambda p, what: m.counts[p, what][d, q].astype(np.int64)  # noqa: B023, E731
                out = [block.ids[q], rows.column("doc_id").to_numpy()[d], whole("t", "focus"), whole("c", "focus"), whole("t", "graph"), whole("c", "graph"), whole("c", "concepts"), flags("t"), flags("c"),
                       m.sizes["t"][d].astype(np.int32), m.sizes["c"][d].astype(np.int32), *[found.marks[x][d].astype(np.int32) for x in MARKS], low[d, q].astype(float), high[d, q].astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.mapInArrow(run, FOUND)
