"""Numbers written as hexadecimal text, of any width, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of a limb, and hexadecimal digits that are added at once.
_LIMB, _STEP = 9, 8


def digits_of(text: Column) -> Column:
    """The hexadecimal digits after 0x without leading zeros; empty for anything else."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), "^(?:0[xX])?([0-9a-fA-F]+)$", 1), "^0+", "")


def hex_long(text: Column) -> Column:
    """A hexadecimal number as long; null if it isn't one or doesn't fit. Up to 15 digits need one match and one conversion."""
    short = F.when(text.rlike("^(?:0[xX])?0*[0-9a-fA-F]{1,15}\\z"), F.when(F.substring(text, 2, 1).isin("x", "X"), F.substring(text, 3, 1 << 30)).otherwise(text))
    return F.conv(F.right(short, F.lit(15)), 16, 10).cast("long")


def hex_decimal(text: Column) -> Column:
    """A hexadecimal number as decimal text; '0' for an empty, null or invalid one. Wide ones are added up in limbs of nine decimals."""
    digits, short = digits_of(text), hex_long(text)
    base, shift = 10**_LIMB, 16**_STEP
    padded = F.lpad(digits, (F.ceil(F.length(digits) / _STEP) * _STEP).cast("int"), F.lit("0"))
    steps = F.transform(F.sequence(F.lit(0), (F.length(padded) / _STEP - 1).cast("int")), lambda i: F.conv(F.substring(padded, i * _STEP + 1, F.lit(_STEP)), 16, 10).cast("long"))

    def add(limbs: Column, step: Column) -> Column:
        start = F.struct(step.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def one(s: Column, x: Column) -> Column:
            t = x * F.lit(shift).cast("long") + s["carry"]
            low = F.pmod(t, F.lit(base).cast("long"))
            return F.struct(F.call_function("div", t, F.lit(base).cast("long")).alias("carry"), F.concat(s["out"], F.array(low)).alias("out"))

        done = lambda s: F.concat(s["out"], F.filter(F.array(F.pmod(s["carry"], F.lit(base).cast("long")), F.call_function("div", s["carry"], F.lit(base).cast("long"))), lambda v: s["carry"] > 0))
        return F.aggregate(limbs, start, one, done)

    limbs = F.aggregate(steps, F.array().cast("array<bigint>"), add)
    wide = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), _LIMB, "0")), ""), "^0+", "")
    return F.coalesce(short.cast("string"), F.when(digits == "", F.lit("0")).otherwise(wide))
