"""A bitmap of hashes as a scalar subquery: what is surely not among some values, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map (a power of two): 65,536 longs, whatever the number of values.
BITS = 22


def bitmap(values: DataFrame, bits: int = BITS) -> Column:
    """The bitmap of the one column of hashes (longs) of ``values``, as one array; made in the cluster by the plan it stands in."""
    name = values.columns[0]
    spot = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    marks = values.select(F.shiftright(spot, 6).cast("int").alias("word"), bit.alias("bit"))
    every = values.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = marks.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = F.sort_array(F.collect_list(F.struct("word", "bits")))  # one array of fixed size
    return words.agg(F.transform(placed, lambda x: x["bits"]).alias("bits")).scalar()


def maybe_in(held: Column, value: Column, bits: int = BITS) -> Column:
    """True for every value that the bitmap was made of, and for few others."""
    at = F.pmod(F.xxhash64(value), F.lit(1 << bits))
    return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
