"""Token-id files coded with a static range asymmetric numeral system.

Documents are sorted by ``doc_id`` over range partitions (shards).  The ids of a shard are cut, between
documents, into sections of about ``SECTION`` ids; one static frequency table is shared by all blocks of a
section.  A block holds ``BLOCK`` ids dealt over ``LANES`` interleaved coder states that share one stream
of 32-bit words.  The checkpoint of a block (its states and the place of its words) and its crc32 make
blocks independent: all blocks of a section are coded side by side in numpy.

The files are a Parquet table of sections, written by Spark, so a lost executor costs a task, not a file.

Defined cases: a null or empty text has the end id alone; rows with equal doc_id are ordered by text; a
null doc_id comes first; an empty table gives an empty file set; further columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm import tokens
from chronoweave.storage import new_path

SECTION, BLOCK, LANES = 1 << 20, 2048, 8
STEPS = BLOCK // LANES
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

SECTIONS = (
    "shard long, section long, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "table binary, bits int, states binary, block_words binary, block_crc binary, payload binary"
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, their frequencies (at least 1, summing to 2**bits), and bits."""
    held = np.bincount(ids)  # as long as the vocabulary at most
    symbols = np.flatnonzero(held)
    counts = held[symbols]
    bits = min(24, max(12, int(len(symbols) - 1).bit_length() + 3))
    share = np.maximum(1, np.floor(counts * (2**bits / counts.sum())).astype(np.int64))
    gap = 2**bits - int(share.sum())
    for i in np.argsort(-share, kind="stable"):
        step = max(gap, 1 - int(share[i])) if gap < 0 else gap
        share[i] += step
        gap -= step
        if not gap:
            break
    return symbols.astype(np.uint32), share.astype(np.uint32), bits


def _tables(symbols: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = share.astype(np.uint64)
    return wide, np.cumsum(wide) - wide


def _crcs(ids: np.ndarray) -> np.ndarray:
    raw = ids.astype("<u4")
    return np.array([zlib.crc32(raw[i : i + BLOCK]) for i in range(0, len(raw), BLOCK)], np.uint32)


def encode(ids: np.ndarray) -> dict[str, object]:
    """A section's table, checkpoints, checksums and words."""
    symbols, share, bits = frequencies(ids)
    f_of, c_of = _tables(symbols, share)
    place_of = np.zeros(int(symbols[-1]) + 1, np.int32)
    place_of[symbols] = np.arange(len(symbols))
    place = place_of[ids]
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, int(np.argmax(share)), np.int64)
    padded[: len(ids)] = place
    lanes = padded.reshape(blocks, STEPS, LANES)
    x = np.full((blocks, LANES), LOW, np.uint64)
    sent, words = np.zeros(lanes.shape, bool), np.zeros(lanes.shape, np.uint32)
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    for t in range(STEPS - 1, -1, -1):
        f, c = f_of[lanes[:, t]], c_of[lanes[:, t]]
        full = x >= f << room
        sent[:, t] = full
        words[:, t] = x.astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << shift) + (x - q * f) + c
    steps = np.diff(symbols, prepend=np.uint32(0)).astype("<u4")
    return {
        "table": zlib.compress(steps.tobytes() + share.astype("<u4").tobytes(), 1),
        "bits": bits,
        "states": x.astype("<u8").tobytes(),
        "block_words": sent.sum((1, 2)).astype("<u4").tobytes(),
        "block_crc": _crcs(ids).astype("<u4").tobytes(),
        "payload": words[sent].astype("<u4").tobytes(),
    }


def decode(part: dict[str, object], n: int) -> np.ndarray:
    """The ids of a section; an error if a checksum or a final state does not fit."""
    table = np.frombuffer(zlib.decompress(part["table"]), "<u4")
    symbols, share = np.cumsum(table[: len(table) // 2], dtype=np.uint32), table[len(table) // 2 :]
    bits = int(part["bits"])
    f_of, c_of = _tables(symbols, share)
    slots = np.repeat(np.arange(len(symbols), dtype=np.int32), share)
    x = np.frombuffer(part["states"], "<u8").reshape(-1, LANES).astype(np.uint64)
    counts = np.frombuffer(part["block_words"], "<u4").astype(np.int64)
    payload = np.append(np.frombuffer(part["payload"], "<u4"), np.uint32(0)).astype(np.uint64)
    at = np.cumsum(counts) - counts
    out = np.empty((len(x), STEPS, LANES), np.int32)
    shift, low = np.uint64(bits), np.uint64(2**bits - 1)
    for t in range(STEPS):
        slot = x & low
        place = slots[slot.astype(np.int64)]
        out[:, t] = place
        x = f_of[place] * (x >> shift) + slot - c_of[place]
        short = x < LOW
        order = np.cumsum(short, 1)
        word = payload[np.minimum(at[:, None] + order - short, len(payload) - 1)]
        x = np.where(short, (x << WORD) | word, x)
        at = at + order[:, -1]
    ids = symbols[out.reshape(-1)[:n]]
    if (x != LOW).any() or (_crcs(ids) != np.frombuffer(part["block_crc"], "<u4")).any():
        raise ValueError("a block of token ids does not fit its checksum")
    return ids


def _encode_batches(path: str, end_id: int):
    def run(batches):
        shard, section, start = TaskContext.get().partitionId(), 0, 0
        held, docs, counts, n = [], [], [], 0

        def close():
            ids = np.concatenate(held)
            part = encode(ids)
            row = [shard, section, start, len(ids), docs, counts, *(part[c] for c in ("table", "bits", "states", "block_words", "block_crc", "payload"))]
            kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2, pa.binary(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SECTIONS.split(", ")])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, ids, at in tokens.encoded(path, batch.column("text")):
                first = 0
                for row in range(hi - lo):
                    held_n = int(at[row + 1] - at[row]) + 1
                    docs.append(names[lo + row])
                    counts.append(held_n)
                    n += held_n
                    if n >= SECTION or row == hi - lo - 1:
                        ends = at[first + 1 : row + 2] - at[first]
                        held.append(np.insert(ids[at[first] : at[row + 1]], ends, np.uint32(end_id)))
                        first = row + 1
                    if n >= SECTION:
                        yield close()
                        section, start = section + 1, start + n
                        held, docs, counts, n = [], [], [], 0
        if docs:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> str:
    """Write the ids of every document in ascending doc_id order; returns the folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token_files")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode_batches(tokenizer, end_id), SECTIONS).write.parquet(path)
    return path


def _sections(batches):
    names = [c.split()[0] for c in SECTIONS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(c)[i].as_py() for c in names}
            ids = decode(part, part["n_tokens"])
            ends = np.cumsum(part["doc_tokens"])
            yield part, ids, ends - part["doc_tokens"], ends


def _read_batches(batches):
    for part, ids, starts, ends in _sections(batches):
        n = len(ends)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part["shard"])), pa.array(part["doc_ids"], pa.int64()), pa.array(starts + part["start"]), lists], ["shard", "doc_id", "in_shard", "ids"]
        )


def _crc_batches(batches):
    for part, ids, starts, ends in _sections(batches):
        raw = ids.astype("<u4")
        crc = np.array([zlib.crc32(raw[s:e]) for s, e in zip(starts, ends)], np.int64)
        n = len(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part["shard"])), pa.array(part["doc_ids"], pa.int64()), pa.array(starts + part["start"]), pa.array(ends - starts), pa.array(crc)],
            ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
        )


def _with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start``: ids of all earlier shards and of the documents before in the shard."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("in_shard"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of every document of the files."""
    files = spark.read.schema(SECTIONS).parquet(path)
    rows = files.mapInArrow(_read_batches, "shard long, doc_id long, in_shard long, ids array<int>")
    return _with_start(rows, files).select("doc_id", "start", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document of the files."""
    files = spark.read.schema(SECTIONS).parquet(path)
    rows = files.mapInArrow(_crc_batches, "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return _with_start(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")
