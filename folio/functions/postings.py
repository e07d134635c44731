"""Posting lists in variable-length digits of gaps: encode, decode and sizes.

A gap is written in base ``coding`` (a power of two), most significant digit first; the last digit
has ``coding`` added. The lists are arrays of strictly increasing positive numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import positions


def gaps(ids: Column) -> Column:
    """Differences of neighbours, the first from 0. Raises unless ids rise strictly from 1 on."""
    found = F.transform(ids, lambda x, i: x - F.coalesce(F.get(ids, i - 1), F.lit(0)))
    return F.transform(found, lambda g: F.when(g <= 0, F.raise_error(F.lit("posting lists rise strictly from 1 on")).cast("bigint")).otherwise(g))


def bits(gap: Column) -> Column:
    return F.length(F.bin(gap))


def _shift(coding: int) -> int:
    shift = coding.bit_length() - 1
    if coding != 1 << shift or not 1 <= shift <= 7:
        raise ValueError("coding must be a power of two up to 128")
    return shift


def n_digits(gap: Column, coding: int = 128) -> Column:
    return F.ceil(bits(gap) / _shift(coding)).cast("int")


def encode(ids: Column, coding: int = 128) -> Column:
    """Binary posting list of an array of ids."""
    shift = _shift(coding)

    def written(g: Column) -> Column:
        top = n_digits(g, coding) - 1
        return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda i: F.lpad(F.hex(F.pmod(F.floor(g / F.pow(F.lit(2.0), i * shift)), F.lit(coding)) + F.when(i == 0, coding).otherwise(0)), 2, "0"))

    return F.unhex(F.array_join(F.flatten(F.transform(gaps(ids), written)), ""))


def code_bytes(coded: Column) -> Column:
    """The bytes of a posting list as numbers."""
    text = F.hex(coded)
    return F.transform(positions(1, F.octet_length(coded)), lambda i: F.conv(F.substring(text, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))


def decode(coded: Column, coding: int = 128) -> Column:
    """The ids of a posting list; digits after the last flagged one are ignored."""
    start = F.struct(F.lit(0).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        more = F.struct((s["gap"] * coding + b).alias("gap"), s["last"].alias("last"), s["out"].alias("out"))
        value = s["last"] + s["gap"] * coding + b - coding
        done = F.struct(F.lit(0).cast("bigint").alias("gap"), value.alias("last"), F.concat(s["out"], F.array(value)).alias("out"))
        return F.when(b >= coding, done).otherwise(more)

    return F.aggregate(code_bytes(coded), start, step, lambda s: s["out"])


def last_element(coded: Column, coding: int = 128) -> Column:
    """The largest id of a posting list, null of an empty one."""
    return F.try_element_at(decode(coded, coding), F.lit(-1))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def is_ordered(a: Column) -> Column:
    return F.forall(positions(1, F.size(a) - 1), lambda i: F.get(a, i - 1) <= F.get(a, i))
