"""Joining wide rows with a narrow table without moving the rows that meet nothing.

The keys of the narrow table are hashed into ``SLOTS`` bits (1 MB, whatever the input).  Rows whose slot is
empty surely meet no key and are passed on where they are; only the others are joined, exactly, by the
caller.  The bits only save work: with far more keys than slots all rows are joined, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.storage import few

SLOTS = 1 << 23


def slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def slot_bits(slots: DataFrame) -> np.ndarray:
    """The numbers of the column m as bits; 256 rows of 4 KB at most come to the driver."""
    words = slots.groupBy(F.shiftright("m", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("m").bitwiseAND(32767)).alias("bits"))
    bits = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for k, part in few(words, SLOTS >> 15).collect():
        bits[k] = np.frombuffer(part, np.uint8)
    return bits.ravel()


def sift(docs: DataFrame, at: Column, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose slot ``at`` is among ``slots`` (column m), and all others."""
    bits = slot_bits(slots)

    @F.arrow_udf("boolean")
    def held(m: pa.Array) -> pa.Array:
        place = np.asarray(m)
        return pa.array(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0)

    return docs.where(held(at)), docs.where(~held(at))


def free_name(docs: DataFrame, name: str = "_") -> str:
    """A name with which no column of ``docs`` begins."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name
