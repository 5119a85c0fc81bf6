"""Bit maps of 64-bit hashes: of fixed size, so that they can be broadcast whatever they stand for.

All hashes asked for pass, and of the others a share that grows with the number of hashes; a join removes those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a hash that number its place.
PLACES = 24
#: As many at most where their number follows that of the hashes.
MOST = 28


def places(hashes: int, more: int = 0) -> int:
    """So many that one place in 16 to 32 is taken, as long as the map is not too large to broadcast, or ``more``."""
    return min(MOST + more, max(PLACES, (16 * hashes).bit_length()))


def piece(hashes: np.ndarray, places: int, bits: int) -> bytes:
    """The part of a bit map that hashes of which the highest bits are equal have places in."""
    taken = np.zeros(1 << (places - bits), bool)
    taken[((hashes >> np.uint64(64 - places)) & np.uint64(len(taken) - 1)).astype(np.int64)] = True
    return np.packbits(taken, bitorder="little").tobytes()


class BitMap:
    """The bit map of a column of hashes of rows, broadcast."""

    def __init__(self, rows: DataFrame, hashes: Column, places: int = PLACES):
        place = F.shiftrightunsigned(hashes, 64 - places)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        words = rows.select(F.shiftright(place, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        got, out = words.toArrow(), np.zeros(1 << (places - 6), np.int64)  # at most that many rows
        out[got["w"].to_numpy()] = got["b"].to_numpy()
        self._share(rows.sparkSession, out.view(np.uint8), places)

    @classmethod
    def of_pieces(cls, spark: SparkSession, pieces: pa.Table, places: int, part: int = 0, parts: int = 1) -> BitMap:
        """From rows (bucket, bits): the bits, as bytes, of the hashes whose highest bits number the bucket, those of the other
        parts before and after; all buckets' are as many."""
        out = np.zeros(1 << (places - 3), np.uint8)
        for bucket, bits in zip(pieces["bucket"].to_pylist(), pieces["bits"], strict=True):
            own = np.frombuffer(bits.as_buffer(), np.uint8).reshape(parts, -1)[part]
            out[bucket * len(own) : (bucket + 1) * len(own)] = own
        made = cls.__new__(cls)
        made._share(spark, out, places)
        return made

    def _share(self, spark: SparkSession, bits: np.ndarray, places: int) -> None:
        self.places, self.shared = places, spark.sparkContext.broadcast(bits)

    def drop(self) -> None:
        """Deletes its copies, each of which is a file of an executor or the driver, once nothing reads it any more."""
        self.shared.destroy()

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be one of the column's."""
        at = (hashes.view(np.uint64) >> np.uint64(64 - self.places)).astype(np.int64)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
