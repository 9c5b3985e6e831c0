"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key bitmap: half a megabyte, whatever the number of keys.
BITMAP_BITS = 22


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = 16) -> DataFrame:
    """``left`` joined to the lookup table ``right`` (one row per key), keys split in ``salts`` parts.

    Rows of a hot key go to as many tasks as there are salts; the lookup rows
    are first cut down to keys that occur, then copied to each salt. Null keys
    find nothing.
    """
    used = left.select(*keys).distinct()
    small = right.join(used, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(small, [*keys, "_salt"], how).drop("_salt")


def key_bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of 2^BITMAP_BITS bits over the leading bits of a column of 64-bit hashes.

    A fixed-size sieve for scans before a join: a key without its bit cannot
    match; the join that follows decides. Built by partial aggregates; at most
    2^BITMAP_BITS / 32768 rows reach the driver.
    """
    x = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS) + 1
    rows = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = bytearray(1 << (BITMAP_BITS - 3))
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes have their bit; ``bitmap`` as np.unpackbits(..., bitorder="little") of key_bitmap."""
    return bitmap[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)].astype(bool)
