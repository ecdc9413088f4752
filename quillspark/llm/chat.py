"""Chat formatting by columnar byte assembly.

Turns come sorted by conversation and turn. For a batch of whole conversations the length of every
segment (mark, role, content, end mark) is known from Arrow offsets; cumulative sums give its place
in the output, and numpy scatters whole columns of bytes into one preallocated Arrow buffer. No
string is built for a single turn.

A turn reads  <|im_start|>ROLE\\nTEXT<|im_end|>\\n . Inside roles and texts every "<", any number of
"\\" and "|" gets one "\\" more before the "|", so that no text holds a mark; taking one away gives
the text back. In roles, "\\" and a line end are written as "\\\\" and "\\n" before that.

Defined results: null text and null role are empty; a null turn sorts first; rows of equal turn
sort by role and text; a null conversation id is one conversation; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

START, END, LOSS_ROLE = b"<|im_start|>", b"<|im_end|>\n", "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def escaped_role(role: Column) -> Column:
    role = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escaped(F.replace(role, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    size = np.diff(offsets)
    first, last = int(offsets[0]), int(offsets[-1])
    out[np.repeat(at - offsets[:-1], size) + np.arange(first, last)] = data[first:last]


def assemble(turns: pa.Table) -> pa.RecordBatch:
    """conv_id, n_turns, formatted, loss_start, loss_end (bytes) of whole conversations in order.
    turns: conv_id, role, text (both escaped), loss."""
    turns = turns.combine_chunks()
    conv, role, text = (turns.column(c).chunk(0) for c in ("conv_id", "role", "text"))
    loss = turns.column("loss").chunk(0).to_numpy(zero_copy_only=False).astype(bool)
    (role_data, role_at), (text_data, text_at) = _bytes_of(role), _bytes_of(text)
    fixed = len(START) + 1 + len(END)
    ends = np.cumsum(np.diff(role_at) + np.diff(text_at) + fixed)
    begins = ends - np.diff(role_at) - np.diff(text_at) - fixed
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    out[begins[:, None] + np.arange(len(START))] = np.frombuffer(START, np.uint8)
    _scatter(out, begins + len(START), role_data, role_at)
    text_begins = begins + len(START) + np.diff(role_at) + 1
    out[text_begins - 1] = ord("\n")
    _scatter(out, text_begins, text_data, text_at)
    text_ends = ends - len(END)
    out[text_ends[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)

    first = np.flatnonzero(_changes(conv))
    edges = np.append(begins[first], ends[-1])
    owner = np.cumsum(_changes(conv)) - 1
    counts = np.bincount(owner[loss], minlength=len(first))
    spans = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    base = edges[owner[loss]]
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array((x[loss] - base).astype(np.int64))) for x in (text_begins, text_ends)]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int64)), buffer).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(np.diff(np.append(first, len(conv))).astype(np.int64)), formatted, *lists],
        names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def _changes(conv: pa.Array) -> np.ndarray:
    """True where a row starts a conversation."""
    null = conv.is_null().to_numpy(zero_copy_only=False)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.ones(len(conv), bool)
    out[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return out


def _whole(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole conversations from sorted batches, of at least `most` bytes but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < most:
            continue
        starts = np.flatnonzero(_changes(b.column("conv_id")))
        cut = int(starts[-1]) if len(starts) > 1 else 0
        if cut:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
            size = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, n_turns, formatted, and the byte spans loss_start, loss_end of each loss text."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), escaped_role(F.col(role_col)).alias("role"), escaped(F.col(text_col)).alias("text"), (F.coalesce(F.col(role_col), F.lit("")) == loss_role).alias("loss"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield assemble(table)

    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>")


TURN = re.compile(re.escape(START.decode()) + r"(.*?)\n(.*?)" + re.escape(END.decode()), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: role and text as they were."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: turns and loss texts, as digests."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                turns = parse(text)
                raw = text.encode()
                loss = "".join(unescape(raw[s:e].decode()) for s, e in zip(starts, ends, strict=True))
                turns_hash = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), turns_hash, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return read_back(chat_format(turns.unionByName(added)))


def _sql_chars() -> str:
    esc = lambda c: f"length(regexp_replace(coalesce({c}, ''), '<(\\\\*)\\|', '<\\1\\\\|', 'g'))"
    return f"{len(START) + 1 + len(END)} + {esc('role')} + {esc('text')}"


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{ADDED_TEXT}'), (-7, 1, 'assistant', '{ADDED_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({_sql_chars()}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
