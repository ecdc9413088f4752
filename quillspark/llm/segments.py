"""Encoding by distinct segments.

Where a tokenizer never joins two segments of a text into one token, the ids of the text are the
ids of its segments one after the other. Segments are stretches of one byte array; Arrow's
dictionary encoding, which compares whole values, names the distinct ones. A worker has the library
encode each of these once, keeps the ids in one flat array and expands texts by numpy gathers.
Segments that differ never meet, whatever their hashes. The store is emptied when it holds more than `most`
segments or `most_ids` ids, so a worker's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa


def chunks(values: list, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of texts of about `most` characters together; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(values):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(values):
        yield slice(start, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of the segments of data that begin at starts and touch each other: the number of each, and what
    the numbers stand for."""
    if not len(starts):
        return np.empty(0, np.int32), []
    offsets = np.append(starts, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def blanks(data: np.ndarray) -> np.ndarray:
    """Where ASCII white space is."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for `size` entries."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


#: For each segment its number of ids and where they start in the array of ids.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def encoded(ids: list[list[int]]) -> Encoded:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.cumsum(size)
    return size, ends - size, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))


def by_lines(library: Callable[[list[str]], list[list[int]]]) -> Callable[[list[bytes]], Encoded]:
    """Encodes many segments in one call, a line end after each: the tokenizer parts before and after
    it, and no other segment has its id. Segments of white space go alone."""
    line_end = library(["\n"])[0]

    def encode(segments: list[bytes]) -> Encoded:
        size, start, flats, used = np.full(len(segments), -1), np.zeros(len(segments), np.int64), [], 0
        texts = [x.decode() for x in segments]
        joined = np.array([i for i, x in enumerate(segments) if not x.isspace()] if len(line_end) == 1 else [], np.int64)
        groups = [joined[a : a + 4096] for a in range(0, len(joined), 4096)]
        for group, ids in zip(groups, library(["\n".join([*[texts[i] for i in g.tolist()], ""]) for g in groups]), strict=True):
            flat = np.array(ids, np.int32)
            ends = np.flatnonzero(flat == line_end[0])
            if len(ends) == len(group):
                start[group] = used + np.concatenate([[0], ends[:-1] + 1])
                size[group] = np.diff(np.concatenate([[-1], ends])) - 1
                flats.append(flat)
                used += len(flat)
        alone = np.flatnonzero(size < 0)
        size[alone], own, flat = encoded(library([texts[i] for i in alone.tolist()]))
        start[alone] = used + own
        return size, start, np.concatenate([*flats, flat])

    return encode


class SegmentEncoder:
    """Encodes numbered segments; the library sees each distinct one once."""

    def __init__(self, encode: Callable[[list[bytes]], Encoded], most: int = 400_000, most_ids: int = 4_000_000):
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self._empty()

    def _empty(self) -> None:
        self.index: dict[bytes, int] = {}
        self.used = 0
        self.start, self.size, self.flat = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        size, start, flat = self.encode(new)
        old, n = len(self.index), len(self.index) + len(new)
        self.index.update(zip(new, range(old, n), strict=True))
        self.start, self.size, self.flat = grown(self.start, n), grown(self.size, n), grown(self.flat, self.used + len(flat))
        self.start[old:n], self.size[old:n] = self.used + start, size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def __call__(self, numbers: np.ndarray, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each; segments are what the numbers stand for."""
        if len(self.index) > self.most or self.used > self.most_ids:
            self._empty()
        known = np.fromiter(map(self.index.get, segments, repeat(-1)), np.int64, len(segments))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = np.arange(len(self.index), len(self.index) + len(new))
            self._learn([segments[i] for i in new.tolist()])
        at = known[numbers]
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], size


def by_text(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of ids of each text, given that of each segment, where segments start and texts end in the data."""
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, np.concatenate([[0], ends]))])
