"""Chat formatting by columnar byte assembly.

The rows of a conversation are brought together and sorted by turn; a task formats all conversations of a batch at once. Segment
lengths give cumulative offsets, and header, text and end of every turn are scattered into one
preallocated buffer that becomes the Arrow string column.

Template: ``<|role|>`` newline, text, ``<|end|>`` newline. A control string can't occur inside a text or a role:
``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, which ``unescape`` undoes exactly.

Nulls: a null text or role is empty; rows of a null conversation id form one conversation; a null turn
comes first. Rows that tie in turn are ordered by role, then text; repeated rows are turns of their own. Bytes that aren't UTF-8 become U+FFFD. An
empty text is a turn without text, an empty table gives no rows, other columns are ignored. A conversation is one output value, so it must fit in a task.
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

from tracelake.llm.common import arrow_map, text_bytes

OPEN, MID, CLOSE = b"<|", b"|>\n", b"<|end|>\n"
LOSS_ROLES = ("assistant",)
_ESCAPED = re.compile(rb"\\(.)", re.S)
_TURN = re.compile(rb"<\|((?:[^<\\]|\\.|<(?!\|))*?)\|>\n((?:[^<\\]|\\.|<(?!\|))*)<\|end\|>\n", re.S)


def utf8(column: pa.Array) -> pa.Array:
    """The bytes of a binary column with what isn't UTF-8 replaced by U+FFFD."""
    try:
        column.cast(pa.string())
        return column
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").encode() for x in column.to_pylist()], pa.binary())


def escape(column: pa.Array) -> pa.Array:
    """Escaped bytes. ``|>`` is escaped as well, so a role can't end its own header."""
    for a, b in ((b"\\", b"\\\\"), (b"<|", b"<\\|"), (b"|>", b"|\\>")):
        column = pc.replace_substring(column, a, b)
    return column


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn, unescaped."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        out.append((unescape(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at byte {at}")
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> None:
    """Copies segment i of ``data`` to ``out`` at ``at[i]``; index arrays cover about ``step`` bytes at a time."""
    lengths = np.diff(offsets)
    row = 0
    while row < len(at):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1)
        if stop == row + 1:
            out[at[row] : at[row] + lengths[row]] = data[offsets[row] : offsets[stop]]
        else:
            shift = np.repeat(at[row:stop] - offsets[row:stop], lengths[row:stop])
            out[shift + np.arange(offsets[row], offsets[stop])] = data[offsets[row] : offsets[stop]]
        row = stop


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array, loss_roles: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of whole conversations, adjacent and in order, to a row for each conversation."""
    role, text = utf8(role), utf8(text)
    wanted = pc.is_in(role, pa.array([r.encode() for r in loss_roles], pa.binary())).to_numpy(zero_copy_only=False)
    (roles, r_off), (texts, t_off) = _buffers(escape(role)), _buffers(escape(text))
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    sizes = len(OPEN) + r_len + len(MID) + t_len + len(CLOSE)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint8)
    r_at, t_at = begin[:-1] + len(OPEN), begin[:-1] + len(OPEN) + r_len + len(MID)
    for word, at in ((OPEN, begin[:-1]), (MID, r_at + r_len), (CLOSE, t_at + t_len)):
        out[(at[:, None] + np.arange(len(word))).reshape(-1)] = np.tile(np.frombuffer(word, np.uint8), len(at))
    _scatter(out, r_at, roles, r_off)
    _scatter(out, t_at, texts, t_off)

    # Where the id changes a conversation begins; nulls are one id.
    value = np.array(pc.fill_null(conv, 0)) if pa.types.is_integer(conv.type) else np.array(conv.to_pylist(), object)
    null = np.array(conv.is_null())
    first = np.ones(len(conv), bool)
    first[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    at = np.flatnonzero(first)
    stop = np.concatenate([at[1:], [len(conv)]])
    offsets = np.concatenate([begin[at], begin[-1:]])
    formatted = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    # Code points before each byte, to give the loss mask in characters.
    chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    own = np.repeat(begin[at], stop - at)
    spans = np.flatnonzero(wanted)
    group = np.searchsorted(at, spans, side="right") - 1
    counts = np.bincount(group, minlength=len(at))
    lo, hi = chars[t_at[spans]] - chars[own[spans]], chars[t_at[spans] + t_len[spans]] - chars[own[spans]]
    mask = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "stop"]))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(at)), formatted.cast(pa.binary()).cast(pa.string()), mask], ["conv_id", "formatted", "loss_spans"])


def _format(loss_roles: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the conversation that the last batch didn't end
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("conv_id")[-1].as_py()
            same = np.array([x == last for x in batch.column("conv_id").to_pylist()])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if held and (cut or held[0].column("conv_id")[0].as_py() != last):
                yield from whole([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from whole([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks()
        yield assemble(*(rows.column(n).chunk(0) for n in ("conv_id", "role", "text")), loss_roles)

    return run


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """A row for each conversation: conv_id, formatted, loss_spans (code points in ``formatted``; the escaped texts of ``loss_roles``)."""
    read = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), text_bytes(F.col(f"`{role_col}`")).alias("role"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    kind = read.schema["conv_id"].dataType.simpleString()
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    return arrow_map(dealt, _format(loss_roles), f"conv_id {kind}, formatted string, loss_spans array<struct<start:bigint,stop:bigint>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text.encode())
            digest = hashlib.sha256()
            for role, said in turns:
                digest.update(b"%b\n%b\n" % (role, said))
            loss = b"".join(unescape(text[s["start"] : s["stop"]].encode()) for s in spans)
            out.append((len(turns), digest.hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text parsed from the formatted strings and reduced to digests."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), _read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
