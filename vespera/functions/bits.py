"""Bit masks as 32-bit words in BIGINT columns, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vespera.config import BitLayout


def bit_index(azimuth: Column, layout: BitLayout) -> Column:
    """The bit of an azimuth; null outside the window, which is never clamped."""
    i = F.floor((azimuth - F.lit(layout.azimuth_min)) / F.lit(layout.step) + F.lit(0.5)).cast("int")
    return F.when(i.between(0, layout.bit_count - 1), i)


def bit_of(index: Column, word: int) -> Column:
    """What a bit contributes to a word: 0 if it lies in another one."""
    return F.when(F.floor(index / 32) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (index % 32).cast("int"))).otherwise(F.lit(0).cast("long"))


def test_bit(words: list[Column], index: Column) -> Column:
    """Whether a bit is set; null for a null index."""
    out = F.lit(False)
    for k, w in enumerate(words):
        out = F.when(F.floor(index / 32) == k, F.call_function("shiftright", w, (index % 32).cast("int")).bitwiseAND(F.lit(1)) == 1).otherwise(out)
    return F.when(index.isNotNull(), out)


def byte_of(words: list[Column], byte: int) -> Column:
    return F.shiftright(words[byte // 4], 8 * (byte % 4)).bitwiseAND(F.lit(255))


def colour(words: list[Column], layout: BitLayout, index: Column) -> Column:
    """transparent without the flag, white if the azimuth's bit is set, black else and without an azimuth."""
    flag = test_bit(words, F.lit(layout.flag_bit))
    return F.when(~flag, "transparent").when(F.coalesce(test_bit(words, index), F.lit(False)), "white").otherwise("black")


def legacy_byte(azimuth: Column) -> Column:
    """An azimuth between 200 and 360 degrees as 0 to 255, clamped."""
    return F.least(F.greatest(F.floor((azimuth - 200) / 160 * 255 + F.lit(0.5)), F.lit(0)), F.lit(255)).cast("int")
