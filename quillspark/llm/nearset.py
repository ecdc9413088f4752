"""Near-duplicate detection by a chosen-path set similarity join.

1. A pass over the texts gives each document its set of distinct word shingles (64-bit hashes), kept
   only as size, digest, 64 minwise tokens and a sketch (bytes of 256). Documents of equal sets form one class.
2. Chosen paths: every tree picks one or two of the 64 token places for its root; a class goes to the
   child named by its token there, and so on down. On average 1 / similarity places are picked, so
   two classes at the threshold share one path of each level in expectation, while unlike ones part
   quickly. Nodes with one class end.
3. Nodes with more than CROWD classes at the first roots are seen to first: each class meets its
   best partner there and the pivots of nodes in which many are nearly equal, and these candidates are
   confirmed. So most of a large group of near copies is one component before all its pairs would meet.
4. Then all nodes of all trees with more than one component: every class outside the largest
   component meets all classes of the node by sketches. A node of at most BLOCK classes is finished
   inside one task, which branches on where that halves the comparisons; larger ones do the same as
   joins on the path, in cells, so no task ever holds one. No class is dropped. A pair counts at
   the first root where it meets in a node that is compared whole. The tasks give no pairs but the
   classes that have a candidate there, a group for each node: rows in proportion to the classes.
5. The full sets, computed again for these classes alone, meet group by group. A task counts
   all intersections through posting lists and returns the links that connect components.
   Independent trees bring the recall near one: a pair at similarity 0.8 shares a root of each tree
   with probability 0.8 or more.
6. Components of the confirmed links, by minimum labels with pointer jumping, as joins.

Candidates have no cap; sketches let a pair at the threshold pass with probability 1 - 3e-5.

Defined results: null text, or text without words, has the empty set, is linked with nothing and
kept; fewer words than the shingle width make one shingle of the whole sequence; rows that repeat
an id or a text are rows of their own in the result and share class and component; a null id gives
no component id to others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, lean, packed, small_batches, stage, unpacked
from .segments import blanks, chunks, distinct, mix

#: Minwise tokens of a set; trees; classes compared exhaustively; classes of a node held in a task.
PLACES, TREES, LEAF, BLOCK, DEPTH = 64, 16, 24, 4096, 48
#: Bytes of a sketch: the low bytes of that many minwise tokens, of which the first PLACES branch.
WIDTH = 256
#: Equal sketch bytes, of 256: a candidate (similarity 0.8 gives 205 +- 6.4), and nearly equal (0.85:
#: at 1.25 branches for each node, a group grows from level to level only where it is that alike).
NEAR, SAME = 178, 218
#: Comparisons of sketches up to which a node is finished at once.
DIRECT = 2_000_000
#: Share of classes nearly equal to the pivot that makes a node tight.
TIGHT = 0.25
#: Classes of a node that is seen to first, and the roots at which; classes that meet a cell at once;
#: shingles of the sets that meet in a task.
CROWD, FIRST_ROOTS, STEP, MOST_SHINGLES = 1024, 5, 512, 1 << 21
#: Rows of a table of ids that may be broadcast (some 50 MB); larger ones are joined by a shuffle.
MOST_BROADCAST = 2_000_000

_U = np.uint64


_STEPS = mix(np.arange(1, 1 + 64, dtype=_U)) | _U(1)
#: Factor and summand of the permutation of 32-bit values behind each minwise token.
_MINWISE = (mix(np.arange(4096, 4096 + 2 * WIDTH, dtype=_U)) >> _U(32)).astype(np.uint32).reshape(WIDTH, 2) | np.array([1, 0], np.uint32)


def words_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of the words of all texts, A-Z lowered: the number of each, the words that the numbers stand
    for, and where each text begins and ends among them."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer((b"\n" + b"\n".join(parts) + b"\n").lower(), np.uint8)  # of bytes, lower() changes A-Z alone
    blank = blanks(data)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # words and white space in turn
    first, sizes = edges[::2], np.diff(edges)[::2]
    numbers, segments = distinct(data[~blank].tobytes(), np.cumsum(sizes) - sizes)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts)))
    return numbers, segments, np.searchsorted(first, np.concatenate([[0], ends]))


def hashed(segments: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, segments), _U, len(segments))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    numbers, segments, upto = words_of(texts)
    return hashed(segments)[numbers], upto


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, upto = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - width + 1), _U)
    for k in range(width):
        grams += words[k : k + len(grams)] * _STEPS[k]
    grams = mix(grams)
    out = []
    for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(grams[a : z - width + 1]))
        elif z > a:
            out.append(mix(np.array([(words[a:z] * _STEPS[: z - a]).sum() + _U(z - a)], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """WIDTH tokens of 32 bits for each set; 0 for empty sets."""
    out = np.zeros((len(sets), WIDTH), np.uint32)
    live = [i for i, s in enumerate(sets) if len(s)]
    if live:
        flat = np.concatenate([sets[i] for i in live])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in live])[:-1]])
        short, h = (flat ^ (flat >> _U(32))).astype(np.uint32), np.empty(len(flat), np.uint32)
        for k in range(WIDTH):
            np.multiply(short, _MINWISE[k, 0], out=h)
            np.add(h, _MINWISE[k, 1], out=h)
            out[live, k] = np.minimum.reduceat(h, first)
    return out


def prepare(docs: DataFrame, width: int, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """id, n_shingles, digest, tokens and sketch of each row, and the columns to carry."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    small_batches(rows)
    more = "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in carry)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in chunks(texts):
                sets = shingles(texts[s], width)
                tokens = minwise(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(s.start, s.stop - s.start), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([t[:PLACES].tobytes() for t in tokens], pa.binary()), pa.array([t.astype(np.uint8).tobytes() for t in tokens], pa.binary()),
                     *(b.column(c).slice(s.start, s.stop - s.start) for c in carry)],
                    names=["id", "n_shingles", "digest", "tokens", "sketch", *carry])

    return rows.mapInArrow(run, f"id long, n_shingles long, digest binary, tokens binary, sketch binary{more}")


def _hash(*parts: int) -> int:
    return xxhash.xxh64_intdigest(np.array([p & (1 << 64) - 1 for p in parts], _U).tobytes())


def root_places() -> list[tuple[int, int]]:
    """tree and token place of the branches at the root."""
    order = sorted(range(PLACES), key=lambda k: _hash(k, 7))
    picked = [(t, order[t]) for t in range(TREES)]
    return picked + [(t, order[TREES + t // 4]) for t in range(0, TREES, 4)]


def places_of(path: int) -> list[int]:
    """The token places that a node picks: 1.25 on average, 1 / 0.8."""
    h = _hash(path, 1)
    first, second = h % PLACES, (h >> 20) % PLACES
    return [first] if (h >> 40) % 4 or first == second else [first, second]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(_U).view(np.int64)


def child_paths(path: int, place: int, values: np.ndarray) -> np.ndarray:
    return mix(values.astype(_U) * _STEPS[5] + _U(_hash(path, place, 2)))


def first_level(classes: DataFrame, roots: int | None = None) -> DataFrame:
    """path, nid, root, label: the branches of all classes at the roots (the first few, or all), which
    are numbered. A class without a label is a component of its own."""
    picked = root_places()[:roots]
    label = F.col("label" if "label" in classes.columns else "nid").alias("label")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32).reshape(-1, PLACES)
                paths = np.concatenate([child_paths(t, k, tokens[:, k]) for t, k in picked])
                root = np.repeat(np.arange(len(picked), dtype=np.int32), b.num_rows)
                own = [pa.array(np.tile(b.column(c).to_numpy(), len(picked))) for c in ("nid", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(paths)), own[0], pa.array(root), own[1]], names=["path", "nid", "root", "label"])

    return classes.select("nid", label, "tokens").mapInArrow(run, "path long, nid long, root int, label long")


def children(own: np.ndarray, sketches: np.ndarray, path: int) -> Iterator[tuple[np.ndarray, int]]:
    """The child nodes of a node that hold more than one class."""
    for place in places_of(path):
        values = sketches[own, place]
        order = np.argsort(values, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            if len(part) > 1:
                yield own[part], _hash(path, place, int(values[part[0]]))


def _groups(batches: Iterator[pa.RecordBatch], key: str, numbers: list[str], blobs: dict[str, type]) -> Iterator[tuple]:
    """The key, the numbers stacked and the blobs as matrices, of each run of rows with equal key."""
    held_key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cols = [np.stack([b.column(c).to_numpy().astype(np.int64) for c in numbers], 1)]
        cols += [np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(len(keys), -1) for c, kind in blobs.items()]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held_key != keys[a]:
                yield int(held_key), *map(np.concatenate, zip(*held, strict=True))
                held = []
            held_key = keys[a]
            held.append([c[a:z] for c in cols])
    if held:
        yield int(held_key), *map(np.concatenate, zip(*held, strict=True))


# ---------------------------------------------------------------- first links in crowded nodes


def stays(equal: np.ndarray, nids: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Which classes of a tight node go on: all that are not nearly equal to its pivot, and one in
    four of those that are."""
    h = mix(nids.astype(_U) * _STEPS[9] ^ (paths.astype(_U) if paths.dtype != object else np.array([int(p) & (1 << 64) - 1 for p in paths], _U)))
    return (equal < SAME) | (h % _U(4) == 0)


def compare(nids: np.ndarray, sketches: np.ndarray, path: int, depth: int, found: set[tuple[int, int]]) -> None:
    """The best partner of each class among the classes of a node and below it."""
    todo = [(np.arange(len(nids)), path, depth)]

    def add(a: int, others: np.ndarray) -> None:
        found.update((min(a, x), max(a, x)) for x in others.tolist() if x != a)

    while todo:
        own, path, depth = todo.pop()
        if len(own) > LEAF and depth < DEPTH:
            pivot = own[np.argmin(mix(nids[own].astype(_U) ^ _U(path & (1 << 64) - 1)))]
            equal = (sketches[own] == sketches[pivot]).sum(1)
            if (equal >= SAME).mean() >= TIGHT:
                add(int(nids[pivot]), nids[own[equal >= NEAR]])
                own = own[stays(equal, nids[own], np.full(len(own), path)) & (own != pivot)]
            todo.extend((part, below, depth + 1) for part, below in children(own, sketches, path))
        elif len(own) > 1:
            best = np.full(len(own), -1)
            score = np.full(len(own), NEAR - 1)
            for i in range(len(own)):
                equal = (sketches[own] == sketches[own[i]]).sum(1)
                equal[i] = -1
                j = int(equal.argmax())
                if equal[j] > score[i]:
                    score[i], best[i] = equal[j], j
            for i in np.flatnonzero(best >= 0).tolist():
                add(int(nids[own[i]]), nids[own[best[i] : best[i] + 1]])


def finish(rows: DataFrame, depth: int) -> DataFrame:
    """Pairs a < b of best partners in nodes that fit a task. rows: path, nid, sketch."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for path, nids, sketches in _groups(batches, "path", ["nid"], {"sketch": np.uint8}):
            compare(nids[:, 0], sketches, path, depth, found)
            if len(found) > 200_000:
                yield _pairs(found)
                found = set()
        if found:
            yield _pairs(found)

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(sorted(found), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, k])) for k in (0, 1)], names=["a", "b"])


def branch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level below nodes that no task should hold: candidates with the pivots, and child rows.
    rows: path, nid, sketch, pivot, pivot_sketch."""
    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk, pv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in ("sketch", "pivot_sketch"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "nid", "sketch", "pivot")), pa.array((sk == pv).sum(1).astype(np.int32))], names=["path", "nid", "sketch", "pivot", "equal"])

    met = stage(rows.select("path", "nid", "sketch", "pivot", "pivot_sketch").mapInArrow(meet, "path long, nid long, sketch binary, pivot long, equal int"), "near-met")
    tight = met.groupBy("path").agg((F.avg(F.when(F.col("equal") >= SAME, 1.0).otherwise(0.0)) >= TIGHT).alias("tight"))
    met = met.join(few(stage(tight, "near-tight")), "path")
    pairs = met.where(F.col("tight") & (F.col("equal") >= NEAR) & (F.col("nid") != F.col("pivot"))).select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b"))

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, nid, pivot, equal = (b.column(c).to_numpy() for c in ("path", "nid", "pivot", "equal"))
            tight = b.column("tight").to_numpy(zero_copy_only=False).astype(bool)
            raw = b.column("sketch").to_pylist()
            out: list[tuple] = []
            for i in np.flatnonzero(~tight | (stays(equal, nid, path) & (nid != pivot))).tolist():
                for place in places_of(int(path[i])):
                    h = _hash(int(path[i]), place, raw[i][place])
                    out.append((h - (1 << 64) if h >> 63 else h, int(nid[i]), raw[i]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "nid", "sketch"])

    return pairs, stage(met.mapInArrow(split, "path long, nid long, sketch binary"), "near-level")


def first_pairs(paths: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates in the nodes of more than CROWD classes among these paths: each class with its best
    partner, and with the pivots of nodes in which many are nearly equal."""
    sketches = classes.select("nid", "sketch")
    sizes = stage(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "near-sizes")
    rows = stage(paths.join(few(sizes.select("path")), "path").join(sketches, "nid").select("path", "nid", "sketch"), "near-rows")
    pairs, depth = [], 1
    while True:
        big = few(sizes.where(F.col("n") > BLOCK).select("path"))  # one in BLOCK rows at most
        pairs.append(finish(rows.join(big, "path", "left_anti"), depth))
        if depth >= DEPTH or big.isEmpty():
            return stage(reduce(DataFrame.unionByName, pairs).distinct(), "near-pairs")
        order = F.xxhash64("path", "nid")
        pivots = rows.join(big, "path").groupBy("path").agg(F.min_by("nid", order).alias("pivot"))
        pivots = stage(pivots.join(sketches.withColumnRenamed("sketch", "pivot_sketch"), F.col("pivot") == F.col("nid")).select("path", "pivot", "pivot_sketch"), "near-pivots")
        met, rows = branch(rows.join(few(pivots), "path"))
        pairs.append(met)
        depth += 1
        sizes = stage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
        rows = stage(rows.join(sizes.select("path"), "path"), "near-rows")


# ---------------------------------------------------------------- all candidates between components

NODE = "path long, nid long, label long, root int, sketch binary, met binary"
NODE_COLUMNS = ["path", "nid", "label", "root", "sketch", "met"]


def mixed(rows: DataFrame, *by: str) -> DataFrame:
    """path, n, main (its largest component), cost of nodes with several components."""
    n = rows.groupBy("path", "label", *by).agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("path", *by).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")).where("most < n")
    return stage(n.select("path", *by, "n", "main", ((F.col("n") - F.col("most")) * F.col("n")).cast("double").alias("cost")), "near-mixed")


def node_rows(paths: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (NODE) of mixed nodes. met holds the class's token at each root whose node is compared
    whole, 0 elsewhere: two classes with an equal token there have met already."""
    places = np.array([k for _, k in root_places()])
    lists = paths.join(sizes.select("path", "n"), "path").groupBy("nid", "label").agg(F.collect_list(F.struct("path", "root", "n")).alias("at"))  # an entry for each root at most
    rows = lists.join(classes.select("nid", "tokens", "sketch"), "nid").select("nid", "label", "tokens", "sketch", "at")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("at")
            sizes, flat = at.value_lengths().to_numpy(), at.flatten()
            owner = np.repeat(np.arange(b.num_rows), sizes)
            path, root, n = (flat.field(c).to_numpy() for c in ("path", "root", "n"))
            tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32).reshape(-1, PLACES)[:, places]
            met = np.zeros_like(tokens)
            whole = n * n <= DIRECT
            met[owner[whole], root[whole]] = tokens[owner[whole], root[whole]]
            met = pa.array([x.tobytes() for x in met], pa.binary())
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(path), b.column("nid").take(take), b.column("label").take(take), pa.array(root), b.column("sketch").take(take), met.take(take)], names=NODE_COLUMNS)

    return rows.mapInArrow(run, NODE)


def near_ones(rest: np.ndarray, own: np.ndarray, labels: np.ndarray, root: int, sketches: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Marks the classes of a node (or of a cell of one) that are a candidate with one of another
    component which did not meet it at an earlier root. Each of `rest` meets all of `own`."""
    marked = np.zeros(len(labels), bool)
    for i in rest.tolist():
        other = own[labels[own] != labels[i]]
        other = other[(sketches[other] == sketches[i]).sum(1) >= NEAR]
        if len(other) and root:
            other = other[~((met[other, :root] == met[i, :root]) & (met[i, :root] != 0)).any(1)]
        if len(other):
            marked[i] = True
            marked[other] = True
    return marked


def unsettled(numbers: np.ndarray, sketches: np.ndarray, met: np.ndarray, path: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of the classes of a node (or of nodes below it) that near_ones marks. No class is
    dropped: all that the largest component lacks meet the node, unless its children together need
    at most half of the comparisons. numbers: nid, label, root."""
    labels, root = numbers[:, 1], int(numbers[0, 2])
    todo = [(np.arange(len(labels)), path, depth)]

    def cost(own: np.ndarray) -> int:
        return (len(own) - int(np.unique(labels[own], return_counts=True)[1].max())) * len(own)

    while todo:
        own, path, depth = todo.pop()
        whole = cost(own)
        if len(own) ** 2 > DIRECT and whole > DIRECT and depth < DEPTH:
            below = [(part, at, depth + 1) for part, at in children(own, sketches, path)]
            if 2 * sum(cost(part) for part, _, _ in below) <= whole:
                todo.extend(below)
                continue
        if whole:
            names, counts = np.unique(labels[own], return_counts=True)
            marked = near_ones(own[labels[own] != names[counts.argmax()]], own, labels, root, sketches, met)
            if marked.any():
                yield path, np.flatnonzero(marked)


def _flagged(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """group, nid, label in batches of some size."""
    held, n = [], 0
    for path, numbers in found:
        held.append(np.column_stack([np.full(len(numbers), _signed(np.array([path & (1 << 64) - 1], _U))[0]), numbers[:, :2]]))
        n += len(numbers)
        if n > 100_000:
            yield _columns(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _columns(np.concatenate(held))


def _columns(a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, k])) for k in range(3)], names=["group", "nid", "label"])


GROUPS = "group long, nid long, label long"
_BLOBS = {"sketch": np.uint8, "met": np.uint32}


def groups_in_tasks(rows: DataFrame, depth: int) -> DataFrame:
    """The groups of nodes that fit a task. rows: NODE."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for path, numbers, sketches, met in _groups(batches, "path", ["nid", "label", "root"], _BLOBS):
            for group, marked in unsettled(numbers, sketches, met, path, depth):
                yield group, numbers[marked]

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(lean(lambda batches: _flagged(found(batches))), GROUPS)


def split_all(rows: DataFrame) -> DataFrame:
    """The child rows of nodes, none dropped, with the path of the parent."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("sketch").to_pylist()
            at, paths = [], []
            for i, path in enumerate(b.column("path").to_pylist()):
                for place in places_of(path):
                    at.append(i)
                    paths.append(_hash(path, place, raw[i][place]))
            if at:
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.array(paths, _U))), *(part.column(c) for c in NODE_COLUMNS[1:]), part.column("path")], names=[*NODE_COLUMNS, "parent"])

    return rows.select(*NODE_COLUMNS).mapInArrow(run, NODE + ", parent long")


def groups_in_cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The groups of nodes of any size: all that the largest component lacks meet the node, in cells
    of STEP times BLOCK classes or so."""
    rows = rows.join(sizes.select("path", "main", F.ceil(F.col("cost") / F.col("n") / STEP).cast("int").alias("across"), F.ceil(F.col("n") / BLOCK).cast("int").alias("down")), "path")
    nth = lambda k: F.pmod(F.xxhash64("nid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    kept = NODE_COLUMNS[1:]
    cells = [
        rows.where("label != main").select("path", *kept, nth("across").alias("x"), every("down").alias("y"), F.lit(0).alias("side")),
        rows.select("path", *kept, every("across").alias("x"), nth("down").alias("y"), F.lit(1).alias("side"))]
    cells = cells[0].unionByName(cells[1]).select(F.xxhash64("path", "x", "y").alias("path"), *kept, "side")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for path, numbers, sketches, met in _groups(batches, "path", ["nid", "label", "root", "side"], _BLOBS):
            side = numbers[:, 3]
            marked = near_ones(np.flatnonzero(side == 0), np.flatnonzero(side == 1), numbers[:, 1], int(numbers[0, 2]), sketches, met)
            if marked.any():
                yield path, np.unique(numbers[marked][:, :2], axis=0)

    return cells.repartition("path").sortWithinPartitions("path").mapInArrow(lean(lambda batches: _flagged(found(batches))), GROUPS)


def groups_of_candidates(paths: DataFrame, classes: DataFrame) -> DataFrame:
    """group, nid, label: every candidate pair of two components is together in a group. From the
    roots down; paths: path, nid, root, label."""
    sizes = mixed(paths)
    rows = node_rows(paths, sizes, classes)
    large = few(stage(sizes.where(F.col("n") > BLOCK).select("path"), "near-large"))
    if large.isEmpty():
        return stage(groups_in_tasks(rows, 1), "near-groups")
    groups = [groups_in_tasks(node_rows(paths.join(large, "path", "left_anti"), sizes, classes), 1)]
    rows = stage(node_rows(paths.join(large, "path"), sizes, classes), "near-large")
    depth = 1
    while not rows.isEmpty():
        big = sizes.where(F.col("n") > BLOCK)
        below = stage(split_all(rows), "near-level")
        sizes = mixed(below, "parent")
        costs = sizes.groupBy("parent").agg(F.sum("cost").alias("below")).withColumnRenamed("parent", "path")
        split = stage(big.join(costs, "path", "left").where((2 * F.coalesce("below", F.lit(0.0)) <= F.col("cost")) & F.lit(depth < DEPTH)).select("path"), "near-split")
        groups.append(groups_in_cells(rows, big.join(few(split), "path", "left_anti")))
        parents = few(split.withColumnRenamed("path", "parent"))
        sizes, depth = stage(sizes.join(parents, "parent").drop("parent"), "near-mixed"), depth + 1
        below = below.join(parents, "parent").drop("parent")
        groups.append(groups_in_tasks(below.join(sizes.where(F.col("n") <= BLOCK).select("path"), "path"), depth))
        rows = stage(below.join(few(sizes.where(F.col("n") > BLOCK).select("path")), "path"), "near-large")
    return stage(reduce(DataFrame.unionByName, groups), "near-groups")


# ---------------------------------------------------------------- exact confirmation


def few(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if a count shows that they are few enough."""
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids


def full_sets(nids: DataFrame, classes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """nid, set (sorted 64-bit hashes, as bytes) of the classes wanted, from the texts again."""
    wanted = stage(classes.select("nid", "id", "digest").join(nids.distinct(), "nid"), "near-wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(few(wanted), "id")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, nids, digests = (b.column(c).to_pylist() for c in ("text", "nid", "digest"))
            for s in chunks(texts):
                sets = shingles(texts[s], width)
                kept = [(n, raw) for n, d, raw in zip(nids[s], digests[s], (x.tobytes() for x in sets), strict=True) if xxhash.xxh3_128_digest(raw) == d]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], names=["nid", "set"])

    return stage(texts.select("text", "nid", "digest").mapInArrow(run, "nid long, set binary").dropDuplicates(["nid"]), "near-sets")


def spanning(nids: np.ndarray, labels: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links (100 * intersection >= percent * union) between components that connect what all links
    among these classes connect; intersections are counted on the full sets through posting lists."""
    sizes = np.array([len(s) // 8 for s in sets], np.int64)
    flat = np.unique(np.frombuffer(b"".join(sets), _U), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    posting, first = owner[order], np.searchsorted(flat[order], np.arange(int(flat.max()) + 2))
    ends = np.cumsum(sizes)
    names, label, counts = np.unique(labels, return_inverse=True, return_counts=True)
    root, links = np.arange(len(names)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(label != counts.argmax()).tolist():
        own = flat[ends[i] - sizes[i] : ends[i]]
        begin, n = first[own], first[own + 1] - first[own]
        upto = np.cumsum(n)
        common = np.bincount(posting[np.repeat(begin - upto + n, n) + np.arange(int(upto[-1]))], minlength=len(sets))
        alike = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i]))
        for j in alike[np.unique(label[alike], return_index=True)[1]].tolist():
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(min(nids[i], nids[j])), int(max(nids[i], nids[j]))))
    return links


def settle(groups: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links a < b in the groups, as many as connect their components. A group whose sets
    together have more than MOST_SHINGLES shingles is cut into parts, every two of which share a cell."""
    sets = full_sets(groups.select("nid"), classes, docs, width, id_col, text_col)
    sized = groups.join(classes.select("nid", "n_shingles"), "nid")
    parts = stage(sized.groupBy("group").agg(F.sum("n_shingles").alias("n")).select("group", F.ceil(F.col("n") / MOST_SHINGLES).cast("int").alias("parts")).where("parts > 1"), "near-parts")
    few_parts = few(parts)
    own, other = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = groups.join(few_parts, "group").select("group", "nid", "label", own.alias("x"), other.alias("y"))
    cells = cells.select(F.xxhash64("group", F.least("x", "y"), F.greatest("x", "y")).alias("group"), "nid", "label")
    rows = groups.join(few_parts, "group", "left_anti").unionByName(cells).join(sets, "nid").select("group", "nid", "label", "set")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []

        def close(held: list[tuple]) -> None:
            if len(held) > 1:
                nids, labels, sets = zip(*held, strict=True)
                links.extend(spanning(np.array(nids), np.array(labels), list(sets), percent))

        now, held = None, []
        for b in batches:
            for group, *rest in zip(*(b.column(c).to_pylist() for c in ("group", "nid", "label", "set")), strict=True):
                if group != now:
                    close(held)
                    now, held = group, []
                held.append(tuple(rest))
        close(held)
        if links:
            yield _pairs(set(links))

    return stage(rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long").distinct(), "near-links")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    sets = full_sets(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")), classes, docs, width, id_col, text_col)
    both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("sb")), "b")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for left, right in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(left, _U), np.frombuffer(right, _U)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "near-links")


def linked(classes: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links a < b that connect what all links connect. Links inside a component that is
    known already are never made, so a group of m near copies costs links in proportion to m."""
    pairs = first_pairs(stage(first_level(classes, FIRST_ROOTS), "near-paths"), classes)
    links = confirm(pairs, classes, docs, width, percent, id_col, text_col)
    known = stage(components(links), "near-roots").withColumnRenamed("root", "label")
    paths = stage(first_level(classes.join(few(known), "nid", "left").withColumn("label", F.coalesce("label", "nid"))), "near-paths")
    return links.unionByName(settle(groups_of_candidates(paths, classes), classes, docs, width, percent, id_col, text_col))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """nid, root: for each class with a link the smallest nid it can reach. In each round every node
    hooks to its least neighbour, chains of hooks are followed to their ends by doubling, and each
    tree becomes one node; only links between trees go on to the next round."""
    edges = stage(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "near-edges")
    labels = None
    for _ in range(rounds):
        up = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
        up = stage(up.select("u", F.least("u", "v").alias("p")), "near-hooks")
        for _ in range(rounds):
            later = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("far")), "p").select("u", F.col("far").alias("p"), (F.col("far") < F.col("p")).alias("moved"))
            later = stage(later, "near-hooks")
            forget(links.sparkSession, up)
            up = later.select("u", "p")
            if later.where("moved").isEmpty():
                break
        labels = up.toDF("nid", "root") if labels is None else stage(labels.join(up.toDF("root", "p"), "root", "left").select("nid", F.coalesce("p", "root").alias("root")), "near-labels")
        edges = edges.join(up.toDF("u", "x"), "u").join(up.toDF("v", "y"), "v")
        edges = stage(edges.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "near-edges")
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs, and the columns to carry."""
    carry = carry or []
    rows = stage(prepare(docs, width, id_col, text_col, carry), "near-rows")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("nid"), "id", "digest", "n_shingles", "tokens", "sketch"), "near-classes")
    links = stage(linked(classes.where("id is not null"), docs, width, percent, id_col, text_col), "near-links")
    if links.isEmpty():
        named = classes.select("digest", F.col("id").alias("component_id"))
    else:
        roots = components(links)
        ids = classes.select("nid", "id").join(roots, "nid")
        lows = ids.groupBy("root").agg(F.min("id").alias("low"))
        low = ids.join(lows, "root").select("nid", "low")
        named = classes.select("nid", "digest", "id").join(low, "nid", "left").select("digest", F.coalesce("low", "id").alias("component_id"))
    named = stage(named, "near-names")
    own = rows.select("id", "n_shingles", *carry, F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = own.where("digest is not null").join(named, "digest").select("id", "n_shingles", "component_id", *carry)
    alone = own.where("digest is null").select("id", "n_shingles", F.col("id").alias("component_id"), *carry)
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80).withColumnRenamed("id", "doc_id")


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8), that with the smallest id, and
    all without near copies; the columns of docs, under any name.

    Defined results: rows are told apart by id and a hash of id and text, so rows that share an id are
    judged each by its own text, and null ids (largest) are judged too; of rows that repeat id and
    text one stays; documents without words all stay; an empty table gives none."""
    own = F.xxhash64("doc_id", "text")
    found = near_duplicates(docs.select(own.alias("sid"), "doc_id", "text"), id_col="sid", carry=["doc_id"])
    found = stage(found.select(F.col("id").alias("sid"), "doc_id", "component_id"), "near-found")
    firsts = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("sid"))).alias("first"))
    firsts = stage(firsts.where("n > 1").select(F.col("component_id").alias("c"), F.col("first.sid").alias("first")), "near-firsts")
    gone = stage(found.join(firsts, (F.col("component_id") == F.col("c")) & (F.col("sid") != F.col("first"))).select(F.col("sid").alias("s"), F.col("doc_id").alias("d")).distinct(), "near-gone")
    # By hash and id together, so rows of different ids never decide for each other.
    same = (F.col("sid") == F.col("s")) & F.col("id").eqNullSafe(F.col("d"))
    out = packed(docs, sid=own, id=F.col("doc_id")).join(few(gone), same, "left_anti")
    twice = found.groupBy("sid", "doc_id").count().where("count > 1").select(F.col("sid").alias("s"), F.col("doc_id").alias("d"))
    if not twice.isEmpty():
        out = out.join(few(twice), same, "left_anti").unionByName(out.join(few(twice), same, "left_semi").dropDuplicates(["sid", "id"]))
    return unpacked(out, docs.columns)
