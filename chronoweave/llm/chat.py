"""Chat formatting by assembling bytes column by column.

Turn rows are sorted by (conversation, turn) over range partitions.  For a run of rows the lengths of all
segments (opening mark, role, line feed, text, closing mark) form a matrix, its running sum says where
each segment lies, and headers and contents are scattered into one preallocated buffer that becomes the
output column.  A conversation that is longer than a run continues in further pieces, so that no task
holds a whole one; pieces are numbered in order.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every ``<`` followed by any
number of backslashes and ``|`` gets one more backslash, so no mark can be forged; in roles backslash and
line feed are written ``\\\\`` and ``\\n``.  ``parse`` undoes this.

Defined cases: null text or role counts as empty; rows with equal turn are ordered by role, then text; a
null turn comes first; rows with a null conv_id form one conversation; repeated rows are repeated turns;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import text as tx

OPEN, CLOSE, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
RUN_BYTES = 4 << 20
PIECES = "conv_id long, piece long, formatted string, n_turns long, loss_start array<int>, loss_end array<int>"


def _escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def _escape_role(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return _escape(column)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all formatted turns, and the places of the segments: one row of six edges per turn."""
    n = len(roles)
    role_bytes, role_at = tx.buffers(roles)
    text_bytes, text_at = tx.buffers(texts)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, "\n", CLOSE + "\n")]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(f) for f in fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    edges = np.zeros(5 * n + 1, np.int64)
    np.cumsum(lengths.ravel(), out=edges[1:])
    out = np.empty(edges[-1], np.uint8)
    starts = edges[:-1].reshape(n, 5)
    for column, piece in zip((0, 2, 4), fixed):
        out[starts[:, column, None] + np.arange(len(piece))] = piece
    for column, content, at in ((1, role_bytes, role_at), (3, text_bytes, text_at)):
        out[np.arange(len(content)) + np.repeat(starts[:, column] - at[:-1], np.diff(at))] = content
    return out, np.concatenate([starts, starts[:, :1] + lengths.sum(1, keepdims=True)], 1)


def _runs(ids: pa.Array) -> np.ndarray:
    """Rows at which another conversation begins."""
    known = np.asarray(pc.is_valid(ids))
    values = np.asarray(pc.fill_null(ids, 0))
    new = np.ones(len(ids), bool)
    new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(new)


def _format_batches(batches):
    piece = TaskContext.get().partitionId() << 33
    for batch in batches:
        role, text = _escape_role(pc.fill_null(batch.column("role"), "")), _escape(pc.fill_null(batch.column("text"), ""))
        ids, assistant = batch.column("conv_id"), pc.equal(batch.column("role"), LOSS_ROLE)
        for lo, hi, _, _ in tx.slices(text, RUN_BYTES):
            out, places = assemble(role.slice(lo, hi - lo), text.slice(lo, hi - lo))
            first = _runs(ids.slice(lo, hi - lo))
            bounds = np.append(first, hi - lo)
            offsets = np.append(places[first, 0], len(out))
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
            loss = np.flatnonzero(np.asarray(pc.fill_null(assistant.slice(lo, hi - lo), False)))
            owner = np.searchsorted(first, loss, "right") - 1
            base = offsets[owner]
            lists = np.searchsorted(loss, bounds).astype(np.int32)
            marks = [pa.ListArray.from_arrays(lists, (places[loss, c] - base).astype(np.int32)) for c in (3, 4)]
            numbers = piece + np.arange(len(first))
            piece += len(first)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).take(pa.array(first)), pa.array(numbers), formatted, pa.array(np.diff(bounds).astype(np.int64)), *marks],
                ["conv_id", "piece", "formatted", "n_turns", "loss_start", "loss_end"],
            )


def format_chats(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Pieces of formatted conversations: text, number of turns, and the byte spans under the loss mask."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    keys = ["conv_id", "turn", "role", "text"]
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions(*keys).mapInArrow(_format_batches, PIECES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    turns = []
    for turn in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


class _Digest:
    """Running digest of one conversation, piece after piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        raw = formatted.encode()
        for lo, hi in zip(starts, ends):
            said = unescape(raw[lo:hi].decode())
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(formatted)

    def row(self) -> list:
        return [self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches):
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    current, digest = None, None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for ident, formatted, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if digest is None or ident != current:
                if digest is not None:
                    done.append([current, *digest.row()])
                current, digest = ident, _Digest()
            digest.add(formatted, starts, ends)
        if done:
            yield out(done)
    if digest is not None:
        yield out([[current, *digest.row()]])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its pieces in order; the state of one is a few numbers."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digest_batches, DIGESTS)
