"""Bloom filters as small tables, sized by the share of absent keys that may pass.

A filter is a table of longs. A key's hash picks a long and up to BITS of its
bits, so that a lookup is one broadcast join by number and no row moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
#: A filter has this many longs at most, about 64 MB as a broadcast; with more keys, more rows pass.
MAX_LONGS = 1 << 20


def passing(keys: float) -> float:
    """The expected share of absent keys that pass, if a long has ``keys`` keys on average (a Poisson number of them)."""
    top = int(keys + 12 * math.sqrt(keys) + 20)
    return sum(math.exp(j * math.log(keys) - keys - math.lgamma(j + 1)) * (1 - (63 / 64) ** (BITS * j)) ** BITS for j in range(top))


def size(n: int, error: float) -> int:
    """How many longs ``n`` keys need, so that a share of ``error`` of absent keys passes."""
    keys = 32.0
    while keys > 1 / 16 and passing(keys) > error:
        keys /= 1.1
    return max(1, min(math.ceil(n / keys), MAX_LONGS))


def _slot(h: Column, longs: int) -> Column:
    return F.pmod(h, F.lit(longs).cast("long"))


def _bits(h: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(BITS):  # from the hash's upper bits
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 64 - 6 * (i + 1)).bitwiseAND(63).cast("int")))
    return out


def build(keys: DataFrame, key: Column, longs: int) -> DataFrame:
    """(slot, bits): the filter of all keys. A null key is hashed like any other."""
    h = keys.select(F.xxhash64(key).alias("h"))
    return h.groupBy(_slot(F.col("h"), longs).alias("slot")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))


def may_hold(rows: DataFrame, key: Column, filter_: DataFrame, longs: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others. Columns stay."""
    r = rows.withColumn("__h", F.xxhash64(key))
    on = (_slot(r["__h"], longs) == filter_["slot"]) & (filter_["bits"].bitwiseAND(_bits(r["__h"])) == _bits(r["__h"]))
    return r.join(F.broadcast(filter_), on, "left_semi").drop("__h")
