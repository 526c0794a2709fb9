"""Bloom filters as DataFrame expressions: built by an aggregate, held by a plan as one scalar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """Double hashing: ``hashes`` bit positions of a key, different at each level."""
    m = F.lit(bits).cast("long")
    h1, h2 = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), m) for i in (0, 1))
    return [F.pmod(h1 + h2 * F.lit(i), m) for i in range(hashes)]


def bloom_words(keys: DataFrame, level: int, hashes: int, bits: int) -> Column:
    """The filter of ``keys`` (column ``key``) as a scalar subquery: an array of ``bits / 64`` words,
    OR-ed per word with map-side combine. The gathering step sees one row per word, a checked size."""
    pos = keys.select(F.explode(F.array(*bit_positions(F.col("key"), level, hashes, bits))).alias("b"))
    ones = pos.select(F.expr("b div 64").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("v"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    words = ones.unionByName(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])
    return words.agg(packed.alias("words")).scalar()


def in_bloom(key: Column, words: Column, level: int, hashes: int, bits: int) -> Column:
    hit = F.lit(True)
    for b in bit_positions(key, level, hashes, bits):
        hit = hit & (F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return hit


def filter_bits(n: int, false_positive: float) -> int:
    """Bits for ``n`` keys at that rate, whole words."""
    return max(64, 64 * math.ceil(n * -math.log(false_positive) / math.log(2) ** 2 / 64))
