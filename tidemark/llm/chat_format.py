r"""Chat formatting by columnar byte assembly.

A turn is written ``<s>[INST]role[/INST]text</s>`` with its control strings ``<s> </s> [INST] [/INST]``.  In roles and
texts every ``\`` becomes ``\\`` and each control string gets a ``\`` after its first character, so a control string
in the output is always the template's own, and reading back takes the ``\`` away again.  The loss mask has the spans of
the assistants' texts, in code points.

The rows come sorted by conversation and turn.  For a batch, numpy works out the lengths of all segments, their
cumulative offsets and where each byte goes, and copies headers, texts and ends into one preallocated buffer, which
becomes the Arrow column as it is.  The scatter indices are made for ``SLICE`` bytes at a time, and a segment larger than that is
copied as it is, so what is held beside the texts and the buffer doesn't grow with either.  A conversation that goes on
in the next batch is finished there.

A conversation is one value of the result, so one task writes it, in some 5 bytes of memory a byte of text; one of 2 GB or more can't be a
value and is refused by an error.

Cases: a null text or role is empty; rows of one turn (ties, repeated rows) are all kept, sorted by role and text; rows
without a turn number come first; rows with a null id are one conversation with a null id; long conversations and very long texts
are written whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import read

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE, END = b"<s>[INST]", b"[/INST]", b"</s>"
LOSS_ROLE = "assistant"
SLICE, MOST, LIMIT = 4 << 20, 512 << 20, (1 << 31) - 1

FORMATTED = "id bigint, n_rows bigint, formatted string, loss_spans array<bigint>"
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\\", "\\\\")
    for c in CONTROLS:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return column


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start of each value, one more at the end; all bytes) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def scatter(out: np.ndarray, to: np.ndarray, at: np.ndarray, data: np.ndarray) -> None:
    """Copy value i of a column (``at``, ``data``) to ``to[i]``, all values at once; a large one as it is."""
    size = np.diff(at)
    if size.sum() <= SLICE:
        index = np.repeat(to - at[:-1], size) + np.arange(at[0], at[-1])
        out[index] = data[at[0] : at[-1]]
    else:
        for place, n, start in zip(to.tolist(), size.tolist(), at.tolist()):
            out[place : place + n] = data[start : start + n]


def fixed(out: np.ndarray, to: np.ndarray, what: bytes) -> None:
    out[(to[:, None] + np.arange(len(what))).ravel()] = np.tile(np.frombuffer(what, np.uint8), len(to))


def slices(turn: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of turns of up to ``SLICE`` bytes, or of one turn."""
    start = 0
    while start < len(turn) - 1:
        stop = max(start + 1, int(np.searchsorted(turn, turn[start] + SLICE, "right")) - 1)
        yield start, stop
        start = stop


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, start of each turn and the end, start and end of each text) for one batch."""
    role_at, role_data = bytes_of(escape(roles))
    text_at, text_data = bytes_of(escape(texts))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = len(OPEN) + n_role + len(CLOSE) + n_text + len(END)
    turn = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(turn[-1], np.uint8)
    role_to = turn[:-1] + len(OPEN)
    text_to = role_to + n_role + len(CLOSE)
    for a, b in slices(turn):
        fixed(out, turn[a:b], OPEN)
        scatter(out, role_to[a:b], role_at[a : b + 1], role_data)
        fixed(out, role_to[a:b] + n_role[a:b], CLOSE)
        scatter(out, text_to[a:b], text_at[a : b + 1], text_data)
        fixed(out, text_to[a:b] + n_text[a:b], END)
    return out, turn, np.stack([text_to, text_to + n_text], 1)


def code_points(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each of the rising places ``at``, the first of which is 0: bytes that don't go on an earlier one."""
    counts, places = [], [0]
    for start in range(0, len(out), SLICE):
        stop = min(start + SLICE, len(out))
        within = at[np.searchsorted(at, start, "right") : np.searchsorted(at, stop)]
        edges = np.unique(np.concatenate([[start], within]))
        counts.append(np.add.reduceat((out[start:stop] & 0xC0) != 0x80, edges - start, dtype=np.int64))
        places.extend([*edges[1:].tolist(), stop])
    before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return before[np.searchsorted(np.array(places), at)]


def formatted_batch(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """One row for each run of rows with the same id."""
    roles, texts = batch.column("role"), batch.column("body")
    out, turn, spans = assemble(roles, texts)
    if len(out) > LIMIT:
        raise ValueError(f"a conversation of {len(out)} bytes is no value: {batch.column('id')[0]}")
    first = starts(batch.column("id"))
    bounds = np.append(first, batch.num_rows)
    loss = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
    points = code_points(out, np.concatenate([np.stack([turn[:-1], spans[:, 0], spans[:, 1]], 1).ravel(), turn[-1:]]))
    begin = points[3 * bounds[:-1]]
    of = np.repeat(np.arange(len(first)), np.diff(bounds))
    masked = (np.stack([points[1:-1:3], points[2::3]], 1) - begin[of][:, None])[loss].ravel()
    n_masked = np.concatenate([[0], np.cumsum(2 * np.bincount(of[loss], minlength=len(first)))])
    offsets = turn[bounds].astype(np.int32)
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out))
    listed = pa.ListArray.from_arrays(pa.array(n_masked, pa.int32()), pa.array(masked, pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(first)), pa.array(np.diff(bounds), pa.int64()), text, listed], schema=schema)


def parted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole conversations of some ``MOST`` bytes of text, or one conversation."""
    first = np.append(starts(batch.column("id")), batch.num_rows)
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])[first]
    start = 0
    while start < len(first) - 1:
        stop = max(start + 1, int(np.searchsorted(size, size[start] + MOST, "right")) - 1)
        yield batch.slice(int(first[start]), int(first[stop] - first[start]))
        start = stop


def starts(ids: pa.Array) -> np.ndarray:
    """Rows at which another id begins (null is an id of its own)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))


def whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a conversation ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = starts(batch.column("id"))
        if not len(first):
            continue
        if held and (batch.column("id")[0].as_py() != held[-1].column("id")[0].as_py()):
            yield joined(held)
            held = []
        if len(first) > 1 and not held:
            yield batch.slice(0, int(first[-1]))
            held = [batch.slice(int(first[-1]))]
        elif len(first) > 1:
            held.append(batch.slice(0, int(first[1])))
            yield joined(held)
            if len(first) > 2:
                yield batch.slice(int(first[1]), int(first[-1] - first[1]))
            held = [batch.slice(int(first[-1]))]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_rows, formatted, loss_spans) for every conversation; loss_spans: start and end of each assistant text."""
    given = turns.select(F.col(id_col).cast("bigint").alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("body"))
    dealt = given.repartition("id").sortWithinPartitions("id", "turn", "role", "body")
    schema = pa.schema([("id", pa.int64()), ("n_rows", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])

    def run(batches):
        for batch in whole_conversations(batches):
            for part in parted(batch):
                yield formatted_batch(part, schema)

    return dealt.mapInArrow(run, FORMATTED)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    for m in TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def parsed(formatted: str) -> list[tuple[str, str]]:
    return list(turns_of(formatted))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader finds in the formatted text: turns by the template, loss text by the mask."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, spans = batch.column("formatted")[i].as_py(), batch.column("loss_spans")[i].as_py()
                every, loss, n_turns, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in turns_of(text):
                    every.update(f"{role}\n".encode())
                    every.update(said.encode())
                    every.update(b"\n")
                    n_turns += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(text[a:b])
                    loss.update(said.encode())
                    n_loss += len(said)
                rows.append((batch.column("id")[i].as_py(), n_turns, every.hexdigest(), n_loss, loss.hexdigest(), len(text)))
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.mapInArrow(run, "id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op7_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    return read_back(format_chats(turns.unionByName(hard))).withColumnRenamed("id", "conv_id")


OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, replace(text, chr(92), chr(92) || chr(92)) AS e FROM c
), s AS (
  SELECT *, replace(replace(replace(replace(e, '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(escaped) + 20)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
