"""Harmonic packing of token sequences.

Pieces are classed by the reciprocal of the capacity: class k takes pieces of at most ``capacity // k``
ids, and a bin of class k holds exactly k of them.  A bin thus needs no search: every task fills the bins
of each class from its own documents.  Remainders of documents are cut so that pieces lie near the top of
their class.  Pieces left over in unfinished bins of all tasks (a fixed number for each task) are numbered
through within their class and fill further bins; what then remains is less than one bin of each class,
a fixed amount, and is packed by decreasing length.

Sequences are written once, as Parquet; ids are little-endian, two bytes each where the vocabulary fits.

Defined cases: a null or empty text has the end id alone; repeated rows are packed once each; a null
doc_id stays null; an empty table gives no sequence; further columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import tokens
from chronoweave.storage import materialise, new_path

CAPACITY = 2048
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128)
SLACK_SHARE, SLACK_IDS = 0.04, 12  # empty part of a slot that is accepted rather than cutting once more
LEFT, TAIL = 1 << 60, 1 << 61  # number ranges of the sequences that are filled after the tasks

PIECE = "struct<doc_id:long,start:long,length:int,doc_tokens:long>"
FILLED = f"class int, sequence_id long, task long, place long, pieces array<{PIECE}>, ids binary"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` ids."""
    out, rest = [(capacity, 1)] * (n // capacity), n % capacity
    while rest:
        k = max(k for k in CLASSES if k * rest <= capacity)
        slot = capacity // k
        if slot - rest <= max(SLACK_SHARE * slot, SLACK_IDS) or k == CLASSES[-1]:
            out.append((rest, k))
            break
        k = min(k for k in CLASSES if capacity // k <= rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


def _width(tokenizer: str, end_id: int) -> np.dtype:
    size = max(tokens.encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    piece = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64())]))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), piece, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["class", "sequence_id", "task", "place", "pieces", "ids"])


def _fill_batches(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        kind, task = _width(tokenizer, end_id), TaskContext.get().partitionId()
        end = np.array([end_id], kind)
        number, open_bins = task << 33, {k: [] for k in CLASSES}
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            for lo, hi, ids, at in tokens.encoded(tokenizer, batch.column("text")):
                ids = ids.astype(kind)
                for row in range(hi - lo):
                    own = np.concatenate([ids[at[row] : at[row + 1]], end])
                    start = 0
                    for length, k in cut(len(own), capacity):
                        piece = ((names[lo + row], start, length, len(own)), own[start : start + length].tobytes())
                        start += length
                        held = open_bins[k]
                        held.append(piece)
                        if len(held) == k:
                            rows.append((k, number, None, None, [p for p, _ in held], b"".join(b for _, b in held)))
                            number += 1
                            open_bins[k] = []
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        left = [(k, None, task, j, [piece], raw) for k, held in open_bins.items() for j, (piece, raw) in enumerate(held)]
        if left:
            yield _batch(left)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks

    return run


def _fill_tail(capacity: int, width: int):
    """Less than a bin of each class, by decreasing length into the first bin with room."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(length=group["ids"].map(len) // width, task=group["task"].astype("int64"), place=group["place"].astype("int64"))
        group = group.sort_values(["length", "class", "task", "place"], ascending=[False, True, True, True])
        room, bins = [], []
        for length, pieces, ids in zip(group["length"], group["pieces"], group["ids"]):
            at = next((i for i, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
                bins.append(([], []))
            room[at] -= length
            bins[at][0].extend(pieces)
            bins[at][1].append(bytes(ids))
        return pd.DataFrame({"sequence_id": [TAIL + i for i in range(len(bins))], "pieces": [p for p, _ in bins], "ids": [b"".join(b) for _, b in bins]})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Sequences (sequence_id, pieces in order, ids) of all documents, and the bytes of one id."""
    spark = docs.sparkSession
    width = _width(tokenizer, end_id).itemsize
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    path = new_path(spark, "packed")
    rows.mapInArrow(_fill_batches(tokenizer, end_id, capacity), FILLED).write.option("compression", "zstd").parquet(path)
    filled = spark.read.schema(FILLED).parquet(path)
    full = filled.where(F.col("sequence_id").isNotNull()).select("sequence_id", "pieces", "ids")

    left = filled.where(F.col("sequence_id").isNull()).drop("sequence_id")
    held = left.groupBy("class", "task").agg(F.count(F.lit(1)).alias("held"))
    tasks = Window.partitionBy("class").orderBy("task")
    total = F.sum("held").over(Window.partitionBy("class"))
    held = held.select("class", "task", (F.sum("held").over(tasks) - F.col("held")).alias("before"), F.floor(total / F.col("class")).alias("bins"))
    ranked = left.join(held, ["class", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("class")))
    whole = ranked.where("bin < bins").groupBy("class", "bin").agg(F.array_sort(F.collect_list(F.struct("rank", "pieces", "ids"))).alias("held"))
    joined = F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    number = F.lit(LEFT) + F.col("class").cast("long") * F.lit(1 << 44) + F.col("bin")
    whole = whole.select(number.alias("sequence_id"), F.flatten(F.transform("held", lambda x: x["pieces"])).alias("pieces"), joined.alias("ids"))
    tail = ranked.where("bin >= bins").select("class", "task", "place", "pieces", "ids")
    tail = tail.groupBy(F.lit(0).alias("g")).applyInPandas(_fill_tail(capacity, width), f"sequence_id long, pieces array<{PIECE}>, ids binary")
    tail = materialise(tail, "packed_tail")  # else its tasks would hold two Python workers each
    return full.unionByName(whole).unionByName(tail), width


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _piece_batches(width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            pieces = batch.column("pieces")
            flat, counts = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
            lengths = flat.field("length").to_numpy().astype(np.int64)
            raw = [np.frombuffer(b.as_buffer(), kind).astype("<u4") for b in batch.column("ids")]
            crc, offset, i = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), 0
            for ids, n in zip(raw, counts):
                at = 0
                for _ in range(n):
                    offset[i], crc[i] = at, zlib.crc32(ids[at : at + lengths[i]])
                    at, i = at + lengths[i], i + 1
            sequence = batch.column("sequence_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            cols = [flat.field("doc_id"), flat.field("start"), pa.array(lengths), pa.array(crc), flat.field("doc_tokens"), sequence, pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pieces(sequences: DataFrame, width: int) -> DataFrame:
    """One row per piece with its place in its sequence and the crc32 of its ids."""
    return sequences.select("sequence_id", "pieces", "ids").mapInArrow(_piece_batches(width), PIECES)
