"""Language-model scores from a causal self-attention model in numpy.

All counts (of words, ids, classes, and of ids after classes, which give most of a score) cover every
position of the training corpus, and the attention weights are fitted on all of it: each training id is
scored once, in windows of STRIDE scored ids. Tables and weights have sizes fixed by parameters, so what reaches the driver does not grow.

The model. Words are lower-cased (A-Z) and encoded, each after a blank, with a public subword
vocabulary; a document ends with the end id. Ids form CLASSES classes by clustering the counts of
what stands next to them. One causal attention head with relative position weights reads the window,
and its output gives the next class, P(class) = softmax(attention @ out + bias), with log P(class | last input) of
the corpus as bias. P(id) = P(class) * P(id | class, class before), the latter from counts.
Probabilities sum to one over all ids. A softmax over all 50,257 ids would take some 30 times the
time allowed; that over classes keeps the attention in charge of every prediction.

Fitting. In each of ROUNDS rounds a share of the training documents, all windows of them,
goes through Adam steps of BATCH windows in the tasks that read them, beginning from the same weights; the weights
are averaged by numbers of windows. All documents take part in one round, so the steps grow with the corpus.

Scoring. Windows of WINDOW inputs begin every STRIDE inputs; each scores its last STRIDE positions,
so each id is scored once and sees at least WINDOW - STRIDE earlier inputs. All windows of a chunk
of documents go through batched masked attention in float32.

The base score needs the count of every word. Words with at least 1 / MOST_FREQUENT of all tokens,
of which there are MOST_FREQUENT at most, travel as a table; what is left is joined by word hash
(64 bits), and that join has no hot key.

Defined results: null text has the end token only; a null id counts as held out; without training
documents counts are zero and the class probabilities even; rows that repeat are treated alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, small_batches, stage
from .nearset import hashed, words_of
from .segments import SegmentEncoder, by_lines, chunks

VOCABULARY, END_ID = 50_257, 50_256
CLASSES, NEAR_IDS, INPUTS, WIDTH, WINDOW, STRIDE = 128, 64, 1024, 16, 32, 24
MOST_FREQUENT, ROUNDS, BATCH = 4_000_000, 4, 128
LOG10E = float(np.log10(np.e))

_encoders: dict[str, SegmentEncoder] = {}


def subwords(ranks_path: str, pattern: str) -> SegmentEncoder:
    """Encodes texts word by word with the ranks of a public vocabulary."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ordinary = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        joined = by_lines(lambda texts: [ordinary(t) for t in texts])
        _encoders[ranks_path] = SegmentEncoder(lambda words: joined([b" " + w for w in words]))
    return _encoders[ranks_path]


# ---------------------------------------------------------------- word counts and the base score


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """word (hash), n over the training documents."""
    rows = train.select(F.col(text_col).alias("text")).where("text is not null")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts, 1 << 22):
                numbers, segments, _ = words_of(texts[s])
                n = np.bincount(numbers, minlength=len(segments))
                at = np.flatnonzero(n)
                words = hashed([segments[i] for i in at.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n[at])], names=["word", "n"])

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """A fixed-size table of the counts of frequent words, sorted by hash."""

    words: np.ndarray
    counts: np.ndarray

    def find(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], -1)


def tokenise(docs: DataFrame, frequent: Frequent, ranks_path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """rid, id, held_out, n_words, sums over its frequent words, its other words, and subword ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), "held_out", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(rows)
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = dict(rows.dtypes)["id"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = subwords(ranks_path, pattern), table.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts, 1 << 22):
                numbers, strings, upto = words_of(texts[s])
                hashes = hashed(strings).view(np.int64)
                counts = known.find(hashes)
                logs = np.log10(np.maximum(counts, 0) + 1.0)
                sizes = np.diff(upto)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                hit = (counts >= 0)[numbers]
                sums = np.bincount(owner, logs[numbers], len(sizes))
                n_hit = np.bincount(owner[hit], minlength=len(sizes))
                rest, rest_owner = hashes[numbers[~hit]], owner[~hit]
                order = np.lexsort((rest, rest_owner))
                rest, rest_owner = rest[order], rest_owner[order]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1])
                once = np.flatnonzero(new)
                times = np.diff(np.append(once, len(rest))).astype(np.int32)
                lists = np.concatenate([[0], np.cumsum(np.bincount(rest_owner[once], minlength=len(sizes)))]).astype(np.int32)
                ids, n_ids = encode(numbers, strings)
                cuts = np.concatenate([[0], np.cumsum(n_ids)])[upto].tolist()
                short = ids.astype("<u2")
                blobs = [short[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("id"), part.column("held_out"), pa.array(sizes), pa.array(sums, pa.float64()), pa.array(n_hit),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(rest[once])), pa.ListArray.from_arrays(pa.array(lists), pa.array(times)), pa.array(blobs, pa.binary())],
                    names=["rid", "id", "held_out", "n_words", "log_sum", "n_hit", "words", "times", "ids"])

    return rows.mapInArrow(run, f"rid long, id {kind}, held_out boolean, n_words long, log_sum double, n_hit long, words array<bigint>, times array<int>, ids binary")


def base_scores(tokens: DataFrame, counts: DataFrame, n_ends: int, total: int, distinct: int) -> DataFrame:
    """rid, id, held_out, n_tokens, n_known, train_tokens, base_score."""
    pairs = tokens.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = pairs.join(counts, "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("n_more"))
    own = tokens.select("rid", "id", "held_out", "n_words", "log_sum", "n_hit").join(found, "rid", "left")
    per_token = float(np.log10(total + 1.0 * (distinct + 1)))
    n_tokens = F.col("n_words") + 1
    return own.select(
        "rid", "id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_hit") + F.coalesce("n_more", F.lit(0)) + (1 if n_ends else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more", F.lit(0.0)) + float(np.log10(n_ends + 1.0)) - n_tokens * per_token).alias("base_score"))


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    input_of: np.ndarray  # id -> input row
    class_of: np.ndarray  # id -> class
    bias: np.ndarray  # input row x class: log P(class | input) of the counts
    in_class: np.ndarray  # id: P(id | class)
    after: np.ndarray  # (class before, id): counts
    after_total: np.ndarray  # (class before, class): counts
    query: np.ndarray  # inputs x (WIDTH + 1)
    key: np.ndarray
    value: np.ndarray
    place: np.ndarray  # WINDOW x WINDOW: relative weights and the causal mask
    out: np.ndarray  # WIDTH x CLASSES

    def within(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(id | its class, the class of the id before it)."""
        return (self.after[before * VOCABULARY + ids] + PRIOR * self.in_class[ids]) / (self.after_total[before * CLASSES + self.class_of[ids]] + PRIOR)


#: Weight of the class-wide distribution against counts of ids after a class; of all inputs against those of one.
PRIOR, POOLED = 10.0, 20.0


#: The input row of what stands before a document; its key is masked.
START_ROW = INPUTS + CLASSES
ROWS = START_ROW + 1


def tally(tokens: DataFrame, size: int, cells_of) -> np.ndarray:
    """How often cells_of(ids, sizes) gives each number below size, over all training documents: an
    array of fixed size, summed in the tasks and then by Spark."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for part in _pieces(b, 1 << 22):
                ids, sizes = _documents(part)
                total += np.bincount(cells_of(ids.astype(np.int64), sizes), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = tokens.where("not held_out").select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def before_of(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray, start: int) -> np.ndarray:
    """table of the id before each id, and start before each document."""
    out = np.roll(table[ids], 1)
    out[np.cumsum(sizes) - sizes] = start
    return out


def frequent_first(n: np.ndarray) -> np.ndarray:
    """The ids that occur, most frequent first, without the end id."""
    order = np.lexsort((np.arange(VOCABULARY), -n))
    order = order[order != END_ID]
    return order[: int((n[order] > 0).sum())]


def neighbours(tokens: DataFrame, n: np.ndarray) -> np.ndarray:
    """Counts of what stands before and after each id in the training documents: a row for each id,
    a column on either side for each of the NEAR_IDS most frequent ids and for all others."""
    column = np.full(VOCABULARY, NEAR_IDS)
    near = frequent_first(n)[:NEAR_IDS]
    column[near] = np.arange(len(near))
    width = 2 * (NEAR_IDS + 1)

    def cells(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        follows = np.ones(len(ids), bool)
        follows[np.cumsum(sizes) - sizes] = False
        right = np.flatnonzero(follows)
        return np.concatenate([ids[right] * width + column[ids[right - 1]], ids[right - 1] * width + NEAR_IDS + 1 + column[ids[right]]])

    return tally(tokens, VOCABULARY * width, cells).reshape(VOCABULARY, width)


def classes_of(n: np.ndarray, table: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """id -> class by clustering what stands next to it in the corpus, and id -> input row."""
    seen = frequent_first(n)
    class_of = np.full(VOCABULARY, CLASSES - 2)
    class_of[END_ID] = CLASSES - 1
    if len(seen) > CLASSES:
        x = table[seen].astype(np.float32)
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        weight = n[seen].astype(np.float64)
        k = CLASSES - 2
        centre = x[:k].copy()
        for _ in range(rounds):
            label = (x @ centre.T * 2 - (centre**2).sum(1)).argmax(1)
            for c in range(k):
                own = label == c
                if own.any():
                    centre[c] = (x[own] * weight[own, None]).sum(0) / weight[own].sum()
        class_of[seen] = label
    input_of = INPUTS + class_of
    input_of[seen[: INPUTS - 1]] = np.arange(len(seen[: INPUTS - 1]))
    return class_of, input_of


@dataclass
class Counts:
    """What the training corpus holds: of classes after inputs, of ids after classes."""

    follow: np.ndarray  # ROWS x CLASSES
    after: np.ndarray  # CLASSES x VOCABULARY

    SIZES = (ROWS * CLASSES, CLASSES * VOCABULARY)

    @staticmethod
    def of(flat: np.ndarray) -> Counts:
        a, b = np.split(flat, [Counts.SIZES[0]])
        return Counts(a.reshape(ROWS, CLASSES), b.reshape(CLASSES, VOCABULARY))

    @staticmethod
    def cells(ids: np.ndarray, sizes: np.ndarray, class_of: np.ndarray, input_of: np.ndarray) -> np.ndarray:
        follow = before_of(ids, sizes, input_of, START_ROW) * CLASSES + class_of[ids]
        return np.concatenate([follow, Counts.SIZES[0] + before_of(ids, sizes, class_of, CLASSES - 1) * VOCABULARY + ids])


def soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def bias_of(counts: Counts) -> np.ndarray:
    prior = counts.follow.sum(0) + 1.0
    follow = counts.follow + POOLED * prior / prior.sum()
    return np.ascontiguousarray(np.log(follow / follow.sum(1, keepdims=True)), np.float32)


Weights = dict[str, np.ndarray]
GAP = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0, WINDOW - 1)
CAUSAL = np.tril(np.ones((WINDOW, WINDOW), bool))
SCORED = slice(WINDOW - STRIDE, WINDOW)


def first_weights() -> Weights:
    """Where fitting begins: no attention output, so the class distribution is that of the counts."""
    rng = np.random.default_rng(9)
    return {
        "e": rng.normal(0, 0.3, (ROWS, WIDTH)), "q": rng.normal(0, 0.25, (WIDTH, WIDTH)), "k": rng.normal(0, 0.25, (WIDTH, WIDTH)), "v": rng.normal(0, 0.25, (WIDTH, WIDTH)),
        "salience": np.zeros(ROWS), "near": np.zeros(WINDOW), "u": np.zeros((WIDTH, CLASSES))}


def gradients(p: Weights, x: np.ndarray, y: np.ndarray, real: np.ndarray, bias: np.ndarray) -> tuple[Weights, float]:
    """Of the mean loss -log P(class) over the scored positions that are real. x: input rows
    (windows x WINDOW); y, real: classes and marks of the scored positions (windows x STRIDE).

    As in score(), salience and the sum of the weights are a further column of keys and of queries and values, so neither
    takes a pass of its own over the weights; inputs not scored ask for nothing."""
    kind, one = bias.dtype, np.ones((ROWS, 1), bias.dtype)
    into = np.hstack([p["q"] / 4, p["k"], p["v"]])
    asks, keys, says = np.split(p["e"] @ into, 3, axis=1)
    salience = p["salience"].copy()
    salience[START_ROW] = -40.0
    scored = x[:, SCORED]
    q, k, v = np.hstack([asks, one]).take(scored, 0), np.hstack([keys, salience[:, None]]).take(x, 0), np.hstack([says, one]).take(x, 0)
    a = q @ k.transpose(0, 2, 1)
    a += np.where(CAUSAL, p["near"][GAP], -1e4)[SCORED].astype(kind)
    np.exp(np.minimum(a, 60, out=a), out=a)
    seen = a @ v
    part = 1 / (seen[..., WIDTH:] + kind.type(1e-30))
    c = seen[..., :WIDTH] * part
    flat = c.reshape(-1, WIDTH)
    d = flat @ p["u"]
    d += bias.take(scored.ravel(), 0)
    if np.abs(flat).max() * np.abs(p["u"]).sum(0).max() > 80:
        np.minimum(d, 80, out=d)
    np.exp(d, out=d)
    total = d @ np.ones(CLASSES, kind)
    share = (real.ravel() / max(1, int(real.sum()))).astype(kind)
    at = np.arange(0, d.size, CLASSES) + y.ravel()
    loss = -float(np.log(d.ravel().take(at) / total + 1e-12) @ share)
    d *= (share / total)[:, None]
    d.ravel()[at] -= share
    g = {"u": (d.T @ flat).T}
    dc = (d @ p["u"].T).reshape(c.shape)
    ds = np.empty_like(seen)
    np.multiply(dc, part, out=ds[..., :WIDTH])
    ds[..., WIDTH] = -np.einsum("bwi,bwi->bw", ds[..., :WIDTH], c)
    da = ds @ v.transpose(0, 2, 1)
    da *= a
    dk = da.transpose(0, 2, 1) @ q
    turned = np.zeros((*x.shape, 3 * WIDTH), kind)
    turned[:, SCORED, :WIDTH] = da @ k[..., :WIDTH]
    turned[..., WIDTH : 2 * WIDTH] = dk[..., :WIDTH]
    turned[..., 2 * WIDTH :] = a.transpose(0, 2, 1) @ ds[..., :WIDTH]
    turned, rows = turned.reshape(-1, 3 * WIDTH), x.ravel()
    dq, g["k"], g["v"] = np.split(p["e"].take(rows, 0).T @ turned, 3, axis=1)
    g["q"] = dq / 4
    g["salience"] = np.bincount(rows, dk[..., WIDTH].ravel(), ROWS)
    g["near"] = np.bincount(GAP[SCORED].ravel(), da.sum(0).ravel(), WINDOW)
    g["e"] = np.stack([np.bincount(rows, column, ROWS) for column in into @ turned.T], 1)
    return g, loss


class Fitting:
    """Adam steps on windows as they come. All weights lie in one array, of which p has the views."""

    def __init__(self, weights: Weights, bias: np.ndarray, rate: float = 0.01):
        self.flat, self.bias, self.rate, self.steps, self.windows, self.losses = np.concatenate([x.ravel() for x in weights.values()]).astype(np.float32), bias, rate, 0, 0, []
        cuts = np.cumsum([x.size for x in weights.values()])
        self.p = {k: part.reshape(x.shape) for (k, x), part in zip(weights.items(), np.split(self.flat, cuts[:-1]), strict=True)}
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> None:
        g, loss = gradients(self.p, x, y, real, self.bias)
        self.losses.append(loss)
        self.steps += 1
        self.windows += len(x)
        grad = np.concatenate([g[name].ravel() for name in self.p]).astype(np.float32)
        self.first += 0.1 * (grad - self.first)
        self.second += 0.01 * (grad * grad - self.second)
        self.flat -= self.rate / (1 - 0.9**self.steps) * self.first / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-9)


def windows_of(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, class_of: np.ndarray, input_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each document, one every STRIDE ids, so that each id is scored once; where they begin is
    shifted as `places` (0 to 1) says, so that ids are met at every place of a window: x, y, real for gradients()."""
    shift = np.floor(places * STRIDE).astype(np.int64)
    n = -(-(sizes + shift) // STRIDE)
    owner = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (nth * STRIDE - shift[owner])[:, None] + np.arange(STRIDE - WINDOW, STRIDE)
    real = (at >= 0) & (at < sizes[owner, None])
    flat = (np.cumsum(sizes) - sizes)[owner, None] + np.where(real, at, 0)
    rows = before_of(ids, sizes, input_of, START_ROW)
    return np.where(real, rows[flat], START_ROW), class_of[ids[flat]][:, SCORED], real[:, SCORED]


def fit_round(tokens: DataFrame, weights: Weights, bias: np.ndarray, class_of: np.ndarray, input_of: np.ndarray, nth: int, rounds: int) -> Weights:
    """Each task takes steps on all windows of the training documents of this round that it reads; the
    weights are then averaged, each task's by its number of windows."""
    shared = tokens.sparkSession.sparkContext.broadcast((weights, bias, class_of, input_of))
    unit = F.shiftrightunsigned(F.xxhash64("id", F.length("ids"), F.lit("window")), 11) * F.lit(2.0**-53)
    rows = tokens.where("not held_out").where(F.pmod(F.xxhash64("id", F.length("ids"), F.lit("round")), F.lit(rounds)) == nth).select("ids", unit.alias("unit"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, class_of, input_of = shared.value
        state, held = Fitting(weights, bias), []
        for b in batches:
            for part in _pieces(b):
                ids, sizes = _documents(part)
                got = windows_of(ids.astype(np.int64), sizes, part.column("unit").to_numpy(), class_of, input_of)
                held = [np.concatenate([h, x]) for h, x in zip(held, got, strict=True)] if held else list(got)
                for a in range(0, len(held[0]) - BATCH + 1, BATCH):
                    state.step(*(h[a : a + BATCH] for h in held))
                held = [h[len(h) // BATCH * BATCH :] for h in held]
        if held and len(held[0]):
            state.step(*held)
        if state.windows:
            flat = np.concatenate([*(x.ravel() for x in state.p.values()), [1.0]]).astype(np.float64) * state.windows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "x"])

    sums = rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    if not sums.num_rows:
        return weights
    flat = np.zeros(sums.num_rows)
    flat[sums.column("cell").to_numpy()] = sums.column("x").to_numpy()
    flat = np.round(flat[:-1] / flat[-1], 6)
    cuts = np.cumsum([x.size for x in weights.values()])
    return {k: part.reshape(x.shape) for (k, x), part in zip(weights.items(), np.split(flat, cuts[:-1]), strict=True)}


def model_of(p: Weights, class_of: np.ndarray, input_of: np.ndarray, counts: Counts) -> Model:
    f32 = lambda a: np.ascontiguousarray(a, np.float32)
    one, salience = np.ones((ROWS, 1)), p["salience"].copy()
    salience[START_ROW] = -40.0
    every = counts.after.sum(0) + 0.5
    in_class = every / np.bincount(class_of, every, CLASSES)[class_of]
    totals = np.stack([np.bincount(class_of, x, CLASSES) for x in counts.after])
    return Model(
        input_of.astype(np.int64), class_of.astype(np.int64), bias_of(counts), f32(in_class), f32(counts.after.ravel()), f32(totals.ravel()),
        f32(np.hstack([p["e"] @ p["q"] / 4, one])), f32(np.hstack([p["e"] @ p["k"], salience[:, None]])), f32(np.hstack([p["e"] @ p["v"], one])), f32(np.where(CAUSAL, p["near"][GAP], -1e4)), f32(p["u"]))


def score(model: Model, ids: np.ndarray, sizes: np.ndarray, most: int = 64) -> np.ndarray:
    """Log10 probability of each document; ids of all of them, each with its end id, one after the other."""
    if not len(sizes):
        return np.zeros(0)
    windows = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(sizes)), windows)
    begins = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    rows = before_of(ids, sizes, model.input_of, START_ROW)  # the input at each position
    likely = np.log(model.within(ids, before_of(ids, sizes, model.class_of, CLASSES - 1)))
    own_class = model.class_of[ids]
    total, ones = np.zeros(len(owner)), np.ones(CLASSES, np.float32)
    back = WINDOW - STRIDE
    span = np.arange(-back, STRIDE)
    for a in range(0, len(owner), most):
        own = owner[a : a + most]
        at = nth[a : a + most, None] * STRIDE + span
        flat = begins[own][:, None] + at
        inside = (at >= 0) & (at < sizes[own][:, None])
        flat = np.where(inside, flat, 0)
        x = np.where(inside, rows[flat], START_ROW)
        weight = model.query.take(x[:, back:], 0) @ model.key.take(x, 0).transpose(0, 2, 1)
        weight += model.place[back:]
        np.exp(np.minimum(weight, 60, out=weight), out=weight)
        seen = weight @ model.value.take(x, 0)
        logits = (seen[..., :WIDTH] / (seen[..., WIDTH:] + 1e-30)).reshape(-1, WIDTH) @ model.out
        logits += model.bias.take(x[:, back:].ravel(), 0)
        target = flat[:, back:].ravel()
        lp = logits.ravel().take(np.arange(0, logits.size, CLASSES) + own_class.take(target)) + likely.take(target)
        np.exp(logits, out=logits)
        lp = np.where(inside[:, back:].ravel(), lp - np.log(logits @ ones), 0).reshape(-1, STRIDE)
        total[a : a + most] = lp.sum(1, dtype=np.float64)
    return np.add.reduceat(total, np.cumsum(windows) - windows) * LOG10E


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """ids with end ids, and the number of each document."""
    parts = [np.append(np.frombuffer(x, "<u2"), np.uint16(END_ID)) for x in batch.column("ids").to_pylist()]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) for x in batch.column("ids").to_pylist()], np.int64)
    group = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z > a:
            yield batch.slice(a, z - a)


def lm_scores(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords for each row of
    docs, which has a boolean column held_out."""
    spark = docs.sparkSession
    train = docs.where(~F.col("held_out"))
    counts = stage(word_counts(train, text_col), "lm-words")
    n_ends = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Words with at least 1 / MOST_FREQUENT of all tokens: no more than MOST_FREQUENT can be.
    top = counts.where(F.col("n") * MOST_FREQUENT >= max(1, words)).toArrow()
    order = np.argsort(top.column("word").to_numpy())
    frequent = Frequent(top.column("word").to_numpy()[order], top.column("n").to_numpy()[order])
    tokens = stage(tokenise(docs, frequent, ranks_path, pattern, id_col, text_col), "lm-tokens")
    base = base_scores(tokens, counts, n_ends, words + n_ends, distinct + (1 if n_ends else 0))

    n = tally(tokens, VOCABULARY, lambda ids, _: ids)
    class_of, input_of = classes_of(n, neighbours(tokens, n))
    counted = Counts.of(tally(tokens, sum(Counts.SIZES), lambda ids, sizes: Counts.cells(ids, sizes, class_of, input_of)))
    weights, bias = first_weights(), bias_of(counted)
    for nth in range(ROUNDS):
        weights = fit_round(tokens, weights, bias, class_of, input_of, nth, ROUNDS)
    model = spark.sparkContext.broadcast(model_of(weights, class_of, input_of, counted))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                ids, sizes = _documents(part)
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(score(model.value, ids, sizes)), pa.array(sizes)], names=["rid", "score", "n_subwords"])

    scored = tokens.select("rid", "ids").mapInArrow(run, "rid long, score double, n_subwords long")
    return base.join(scored, "rid").drop("rid")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out("doc_id"))
    return lm_scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
