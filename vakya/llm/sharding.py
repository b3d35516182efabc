"""Jump consistent hashing of stable keys to shards, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Multiplier of the published jump hash's generator, in limbs of 22 bits, so that no product overflows.
_MULTIPLIER = 2862933555777941757
_BITS = 22
_MASK = (1 << _BITS) - 1
_TOP_MASK = (1 << 20) - 1
_A = (_MULTIPLIER & _MASK, (_MULTIPLIER >> _BITS) & _MASK, _MULTIPLIER >> (2 * _BITS))
#: The walk takes about ln(shards) steps; more than this many steps is an error, never a wrong shard.
_MOST_STEPS = 256


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a bigint key, after Lamping and Veach; a null key is null.

    With one more shard, a key stays or moves into the new shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(
        key.bitwiseAND(_MASK).alias("x0"), F.shiftrightunsigned(key, _BITS).bitwiseAND(_MASK).alias("x1"),
        F.shiftrightunsigned(key, 2 * _BITS).alias("x2"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"),
    )

    def product(s: Column) -> Column:
        r0 = s["x0"] * F.lit(_A[0]) + 1
        r1 = s["x0"] * F.lit(_A[1]) + s["x1"] * F.lit(_A[0])
        r2 = s["x0"] * F.lit(_A[2]) + s["x1"] * F.lit(_A[1]) + s["x2"] * F.lit(_A[0])
        return F.struct(r0.alias("r0"), r1.alias("r1"), r2.alias("r2"), s["j"].alias("j"), s["b"].alias("b"))

    def carried(s: Column) -> Column:
        r1 = s["r1"] + F.shiftright(s["r0"], _BITS)
        return F.struct(s["r0"].bitwiseAND(_MASK).alias("x0"), r1.bitwiseAND(_MASK).alias("x1"),
                        (s["r2"] + F.shiftright(r1, _BITS)).bitwiseAND(_TOP_MASK).alias("x2"), s["j"].alias("b"))

    def jumped(s: Column) -> Column:
        high = F.shiftleft(s["x2"], 11).bitwiseOR(F.shiftright(s["x1"], 11))  # key >> 33
        j = F.floor((s["b"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double")))
        return F.struct(s["x0"], s["x1"], s["x2"], s["b"], j.cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        def through(value: Column, *functions) -> Column:  # a one-element array binds a value once
            a = F.array(value)
            for f in functions:
                a = F.transform(a, f)
            return a[0]

        return F.when(s["j"] >= shards, s).otherwise(through(s, product, carried, jumped))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, _MOST_STEPS))), start, step)
    out = F.when(end["j"] >= shards, end["b"]).otherwise(F.raise_error(F.lit("jump hash did not end")).cast("bigint"))
    return F.when(key.isNotNull(), out.cast("int"))


def assign(rows: DataFrame, key: Column, shards: int, grown: int | None = None) -> DataFrame:
    """Add ``shard`` and, if asked, ``grown_shard`` (of ``grown`` shards). Null keys hash like any value."""
    out = rows.withColumn("shard", jump_hash(F.xxhash64(key), shards))
    return out.withColumn("grown_shard", jump_hash(F.xxhash64(key), grown)) if grown else out


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 within each ``shard``, without gathering a shard in one task.

    The narrow rows are written once with the partition they came from; rows
    are numbered inside (shard, partition) and shifted by the counts of the
    partitions before. Repeated rows have slots of their own.
    """
    dealt = materialise(rows.withColumn("_part", F.spark_partition_id()), "slots")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    first = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("shard", "_part").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(first, ["shard", "_part"]).withColumn("slot", (F.col("_own") + F.col("_first")).cast("bigint"))
        .drop("_own", "_first", "_part")
    )
