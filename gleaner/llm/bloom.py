"""Bloom filters as DataFrames of 64-bit words, built and tested with built-in functions alone.

A filter has ``bits_per_row`` bits for each row, but never more than ``filter_bytes`` in all, which bounds
what is broadcast. Where that bound is met, more rows pass the test than must; since a filter only says
which rows need a closer look, its size changes neither a plan nor a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
#: Bytes that a row (word, bits) of a filter takes in a broadcast table.
ROW = 16
FILTER_BYTES = 64 << 20


def filter_bits(rows: int, bits_per_row: int = 16, filter_bytes: int = FILTER_BYTES) -> int:
    return WORD * max(1, min(max(16, -(-rows * bits_per_row // WORD)), filter_bytes // ROW))


def slots(key: Column, bits: int) -> list[Column]:
    """Two slots of a key."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def words_of(hit_slots: DataFrame) -> DataFrame:
    """The filter that has the bits of the column ``slot`` set: word, bits."""
    bit = F.expr(f"shiftleft(1L, cast(slot % {WORD} as int))")
    return hit_slots.groupBy(F.expr(f"slot div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def tested(df: DataFrame, key: Column, bits: int, words: DataFrame, name: str) -> DataFrame:
    """df and a boolean column: whether both slots of the key are set. words has at most bits / WORD rows,
    which filter_bits bounds."""
    columns = df.columns
    out = df.withColumns({f"__slot{i}": s for i, s in enumerate(slots(key, bits))})
    for i in (0, 1):
        one = F.broadcast(words.select(F.col("word").alias(f"__word{i}"), F.col("bits").alias(f"__bits{i}")))
        out = out.withColumn(f"__at{i}", F.expr(f"__slot{i} div {WORD}"))
        out = out.join(one, F.col(f"__at{i}") == F.col(f"__word{i}"), "left")
    hit = [F.coalesce(F.expr(f"(__bits{i} & shiftleft(1L, cast(__slot{i} % {WORD} as int))) != 0"), F.lit(False)) for i in (0, 1)]
    return out.select(*columns, (hit[0] & hit[1]).alias(name))


def flag_members(df: DataFrame, key: Column, members: DataFrame, name: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """df and a boolean column: false only if the key isn't in the one column of members."""
    bits = filter_bits(members.count(), filter_bytes=filter_bytes)
    column = F.col(members.columns[0])
    words = words_of(members.select(F.explode(F.array(*slots(column, bits))).alias("slot")))
    return tested(df, key, bits, words, name)
