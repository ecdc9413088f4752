"""Words, sentences and marks of a chunk of texts at once, from their bytes: what the columns of
`functions` give of one text, for the pass that reads all documents. A title is the first line of its text.

Bytes are classed by tables, and stretches of a class are words; white space runs are closed up to one blank by a
mask. Texts with characters that normalisation replaces are rare and go through str.replace first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import DROPPED, ELLIPSIS, ONE_TO_ONE, SCAFFOLD

REPLACED = [*ONE_TO_ONE.items(), *((c, "") for c in DROPPED), (ELLIPSIS, "...")]
#: Letters beyond ASCII whose lower case holds an ASCII letter.
LOWERED = [("\u212a", "k"), ("\u0130", "i\u0307")]


def marked(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IN_TOKEN, IN_WORD, IN_DIGITS, CAPITAL, SMALL_LETTER = marked(DIGITS + SMALL + LARGE + "'"), marked(DIGITS + SMALL + LARGE + "_"), marked(DIGITS), marked(LARGE), marked(SMALL)
WHITE, STOP = marked(" \t\n\x0b\f\r"), marked(".!?")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKED = np.arange(256, dtype=np.uint8)
BLANKED[WHITE] = 32

SCAFFOLDING = re.compile(rf"(?<!\w)({SCAFFOLD})", re.I | re.A)
EIGHT = re.compile("([^\n\r\u0085\u2028\u2029])\\1{7}")


def one_of(characters: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]"


def replaced(texts: pa.Array, pairs: list[tuple[str, str]]) -> tuple[pa.Array, np.ndarray]:
    """texts with characters replaced, and which have any of them."""
    has = pc.match_substring_regex(texts, one_of("".join(a for a, _ in pairs)))
    odd = has.to_numpy(zero_copy_only=False)
    if not odd.any():
        return texts, odd
    new = []
    for text in texts.filter(has).to_pylist():
        for a, b in pairs:
            text = text.replace(a, b)
        new.append(text)
    return pc.replace_with_mask(texts, has, pa.array(new, texts.type)), odd


@dataclass
class Bytes:
    """Texts one after the other, each closed by a line end, and where each begins."""

    data: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Bytes:
        closed = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        _, offsets, values = closed.buffers()
        first = np.frombuffer(offsets, np.int64)[closed.offset : closed.offset + len(closed) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        return Bytes(data[first[0] : first[-1]], first - first[0])

    def row(self, at: np.ndarray) -> np.ndarray:
        """The text of each place; places ascend."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(np.searchsorted(at, self.first)))

    def stretches(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the longest stretches of marked bytes begin and end, and the mask. A line end is never marked."""
        inside = table[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        return edges[::2], edges[1::2], inside

    def line_ends(self) -> np.ndarray:
        """Where the first line of each text ends."""
        ends = np.flatnonzero(self.data == 10)
        return ends[np.searchsorted(ends, self.first[:-1])]


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


@dataclass
class Words:
    """The distinct words of each text: text and number of each, and the words that the numbers stand for."""

    row: np.ndarray
    code: np.ndarray
    words: pa.Array

    @staticmethod
    def of(row: np.ndarray, code: np.ndarray, words: pa.Array) -> Words:
        n = max(1, len(words))
        cells = np.sort(row * n + code)
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
        return Words(cells // n, cells % n, words)

    def where(self, rows: np.ndarray) -> Words:
        return Words(self.row[rows[self.row]], self.code[rows[self.row]], self.words)

    def plus(self, other: Words) -> Words:
        """With the words of other texts."""
        return Words(np.concatenate([self.row, other.row]), np.concatenate([self.code, other.code + len(self.words)]), pa.concat_arrays([self.words, other.words]))

    def sizes(self, n_rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=n_rows)


def tokens(texts: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Place, text and number of each token, and the tokens that the numbers stand for."""
    begin, end, inside = texts.stretches(IN_TOKEN)
    codes = strings(LOWER[texts.data[inside]], end - begin).dictionary_encode()
    long = end - begin >= 2
    begin = begin[long]
    return begin, texts.row(begin), codes.indices.to_numpy()[long].astype(np.int64), codes.dictionary


def inside_of(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def summed(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many marks each stretch has; sizes are 1 at least."""
    return np.add.reduceat(marks, np.cumsum(sizes) - sizes, dtype=np.int32) if len(sizes) else sizes


def capitalised(texts: Bytes, begin: np.ndarray, end: np.ndarray) -> Words:
    """Capitalised words that do not begin a sentence, as rules.proper_words gives them, of the words at begin to end."""
    data = texts.data
    some = CAPITAL[data[begin]] & (end - begin >= 3)
    begin, sizes = begin[some], (end - begin)[some]
    row, letters = texts.row(begin), data[inside_of(begin, sizes)]
    after_stop = WHITE[data[begin - 1]] & STOP[data[begin - 2]] & (begin - texts.first[row] >= 2)
    some = (summed(SMALL_LETTER[letters], sizes) == sizes - 1) & ~after_stop
    codes = strings(letters[np.repeat(some, sizes)], sizes[some]).dictionary_encode()
    return Words.of(row[some], codes.indices.to_numpy().astype(np.int64), codes.dictionary)


def noisy_words(texts: Bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and text of the words of ten and more ASCII letters and digits with both of them, of the words at begin to end."""
    some = end - begin >= 10
    begin, sizes = begin[some], (end - begin)[some]
    letters = texts.data[inside_of(begin, sizes)]
    digits = summed(IN_DIGITS[letters], sizes)
    begin = begin[(digits > 0) & (digits < sizes) & (summed(letters == 95, sizes) == 0)]
    return begin, texts.row(begin)


def in_a_row(same: np.ndarray, n: int) -> np.ndarray:
    """Where n marks in a row begin."""
    have = 1
    while have < n:
        step = min(have, n - have)
        same = same[:-step] & same[step:]
        have += step
    return np.flatnonzero(same)


def repeats(told: Bytes, texts: pa.Array) -> np.ndarray:
    """Which texts hold a character eight times in a row."""
    data, found = told.data, np.zeros(len(texts), bool)
    widest = int(data.max()) if len(data) else 0
    for width, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        if widest >= lead and len(data) > 8 * width:
            found[told.row(in_a_row(data[width:] == data[:-width], 7 * width))] = True
    for i in np.flatnonzero(found).tolist():
        found[i] = EIGHT.search(texts[i].as_py()) is not None
    return found


def closed_up(texts: Bytes) -> tuple[Bytes, np.ndarray]:
    """White space runs as one blank, none before a text and one behind it (none in a blank text), and how many
    characters of each first line that leaves."""
    white = WHITE[texts.data]
    keep = ~white
    keep[1:] |= ~white[:-1]
    left = np.flatnonzero(~keep)
    upto = lambda at: at - np.searchsorted(left, at)
    first, titles = upto(texts.first), upto(texts.line_ends())
    data = BLANKED[texts.data[keep]]
    sizes = titles - first[:-1]
    inside = sizes > 0
    sizes[inside] -= data[titles[inside] - 1] == 32
    return Bytes(data, first), sizes


def sentences(told: Bytes, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many sentences each text has, and how many of more than 20 characters that are no scaffolding."""
    data, first, n_rows = told.data, told.first, len(texts)
    blank = np.flatnonzero(data == 32)
    filled = np.diff(first) > 0
    ends = first[1:][filled] - 1
    inner = np.zeros(len(data), bool)
    inner[blank[STOP[data[blank - 1]]]] = True
    inner[ends] = True
    stop = np.flatnonzero(inner)
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    row = told.row(stop)
    further = np.flatnonzero((data & 0xC0) == 0x80)  # bytes of a character behind its first
    long = (stop - np.searchsorted(further, stop)) - (begin - np.searchsorted(further, begin)) > 20
    counted, usable = np.bincount(row, minlength=n_rows), np.bincount(row[long], minlength=n_rows)
    for i in np.flatnonzero(pc.match_substring_regex(texts, rf"(?i)\b({SCAFFOLD})").to_numpy(zero_copy_only=False)).tolist():
        parts = re.split(r"(?<=[.!?]) ", texts[i].as_py().rstrip(" "))
        usable[i] = sum(len(x) > 20 and SCAFFOLDING.search(x) is None for x in parts)
    return counted, usable


def terms_in(texts: pa.Array, titles: pa.Array, terms: list[str]) -> np.ndarray:
    """How many of the terms each title and text, with a blank between them, hold; texts and titles closed up."""
    pattern = "(?i)" + "|".join(map(re.escape, terms))
    most = max(map(len, terms))
    seam = pc.binary_join_element_wise(pc.utf8_slice_codeunits(titles, -most), pc.utf8_slice_codeunits(texts, 0, most), " ")
    some = pc.or_(pc.match_substring_regex(texts, pattern), pc.match_substring_regex(seam, pattern)).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(some).tolist():
        lower = f"{titles[i].as_py()} {texts[i].as_py()}".lower()
        out[i] = sum(t in lower for t in terms)
    return out


#: Numbers of a document that its scores need.
MARKS = ("n_title", "n_tokens", "sentences", "usable", "defining", "defined", "listicle", "repeated", "digits", "noisy", "terms")


class Scan:
    """The distinct words of title, content and the flat text of both (t, c, e), the capitalised words of the content, and
    MARKS: tokens of title and content, sentences and usable ones, defining words and whether the title has some or
    is that of a list, whether a character comes eight times or a digit ten times in a row, noisy words, spam terms."""

    def __init__(self, raw: pa.Array, defining: str, listicle: str, terms: list[str]):
        n = len(raw)
        raw = raw.fill_null("")
        plain, odd = replaced(raw, REPLACED)
        lower, other = replaced(plain, LOWERED)
        texts = Bytes.of(plain)
        low = Bytes.of(lower) if other.any() else texts
        at, row, code, words = tokens(low)
        titled = at < low.line_ends()[row]
        self.words = {"t": Words.of(row[titled], code[titled], words), "c": Words.of(row, code, words)}
        self.words["e"] = self.words["c"]
        if odd.any():
            # The flat text keeps what normalisation drops or turns into a part of a token.
            flat, _ = replaced(raw.filter(pa.array(odd)), LOWERED)
            _, r, c, w = tokens(Bytes.of(flat))
            self.words["e"] = self.words["c"].where(~odd).plus(Words.of(np.flatnonzero(odd)[r], c, w))
        begin, end, _ = texts.stretches(IN_WORD)
        noisy_at, noisy_row = noisy_words(texts, begin, end)
        if odd.any():
            written = Bytes.of(raw)
            self.proper = capitalised(written, *written.stretches(IN_WORD)[:2])
        else:
            self.proper = capitalised(texts, begin, end)

        told, title_sizes = closed_up(texts)
        whole = strings(told.data, np.diff(told.first))
        title = pc.utf8_trim(pc.list_element(pc.split_pattern(raw, "\n", max_splits=1), 0), " ")
        head = pc.binary_join_element_wise(title, pc.utf8_slice_codeunits(raw, 0, 700), ". ")
        flag = lambda column, pattern: pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
        in_title = noisy_at < texts.line_ends()[noisy_row]
        counted, usable = sentences(told, whole)
        data = told.data.tobytes()
        closed_titles = pa.array([data[a : a + k].decode() for a, k in zip(told.first[:-1].tolist(), title_sizes.tolist(), strict=True)], pa.string())
        self.marks = {
            "n_title": np.bincount(row[titled], minlength=n), "n_tokens": np.bincount(row, minlength=n), "sentences": counted, "usable": usable,
            "defining": pc.count_substring_regex(head, defining).to_numpy(zero_copy_only=False).astype(np.int64), "defined": flag(title, defining),
            "listicle": flag(title, listicle.replace(r"\s", r"[\s\x0b]")), "repeated": repeats(told, whole).astype(np.int64), "digits": flag(whole, "[0-9]{10}"),
            "noisy": np.bincount(noisy_row, minlength=n) + np.bincount(noisy_row[in_title], minlength=n), "terms": terms_in(whole, closed_titles, terms)}
