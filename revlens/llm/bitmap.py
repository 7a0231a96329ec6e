"""A bitmap of hashed keys: a filter of bounded size that lets every listed key pass, and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the greatest number of bits: 16 MB, whatever the number of keys. Beyond it more keys that
#: aren't listed pass, which costs time but never changes a result.
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Bits that one task gathers.
_CHUNK = 1 << 18


def size(n_keys: int) -> int:
    """Bits for so many keys: a power of two from 64 up."""
    return min(MOST_BITS, max(64, 1 << (n_keys * BITS_A_KEY - 1).bit_length()))


def _gather(bits: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = min(bits, _CHUNK)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.asarray(batch.column("bit"))
            for c in np.unique(at // chunk).tolist():
                here = held.setdefault(c, np.zeros(chunk, bool))
                here[at[at // chunk == c] % chunk] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["chunk", "packed"])

    return gather


def collect(keys: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the long column `key` as little-endian words on the driver: bits / 8 bytes."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1)).alias("bit")
    rows = keys.select(at).withColumn("chunk", F.floor(F.col("bit") / _CHUNK)).repartition("chunk").select("bit").mapInArrow(_gather(bits), "chunk long, packed binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    step = min(bits, _CHUNK) // 8
    for r in rows:
        out[r["chunk"] * step : (r["chunk"] + 1) * step] |= np.frombuffer(r["packed"], np.uint8)
    return out.view("<u8")


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (signed or unsigned 64-bit) pass."""
    bit = keys.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def column(words: np.ndarray, spark) -> DataFrame:
    """One row with the words as an array, for a test inside Spark."""
    return spark.createDataFrame([(words.view("<i8").tolist(),)], "words array<long>")


def test(key: Column, bits: int) -> Column:
    """Whether a long passes the bitmap in column `words`."""
    bit = key.bitwiseAND(F.lit(bits - 1))
    word = F.get("words", F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
