"""Null-safe scalar column functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_FLOOR = 1e-12

# The texts that mean "missing" in a delimited demand file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Signs that count as blank, and signs a plain decimal number is made of.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_SIGNS = "0123456789+-.eE"


def text_or_null(text: Column) -> Column:
    """Text with the missing-value tokens turned into NULL."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def number_or_null(text: Column) -> Column:
    """Double parsed from text; NULL where the text is no plain decimal number and no infinity."""
    bare = strip(text)
    plain = (F.translate(bare, NUMBER_SIGNS, "") == "") | F.ltrim(F.lower(bare), F.lit("+-")).isin("inf", "infinity")
    return F.when(plain, bare.try_cast("double"))


# Spellings of a day besides ISO, in the order in which they are tried: month first, then day first.
SLASHED = ["y/M/d", "M/d/y", "d/M/y"]
NAMED = ["d MMMM y", "d MMM y", "MMMM d, y", "MMM d, y", "MMMM d y", "MMM d y", "d-MMM-y"]


def day_or_null(text: Column) -> Column:
    """Date parsed from text; NULL where it is no date.

    ISO text with or without a time of day, `20160301`, `2016/03/01`, `03/01/2016` (the month first,
    unless it cannot be), and days with an English month name.
    """
    bare = strip(text)

    def first_of(formats: list[str]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])

    parsed = (
        F.when(F.substring(bare, 5, 1) == "-", F.try_to_timestamp(bare))
        .when(F.contains(bare, F.lit("/")), first_of(SLASHED))
        .when((F.length(bare) == 8) & (F.translate(bare, "0123456789", "") == ""), F.try_to_timestamp(bare, F.lit("yyyyMMdd")))
        .when(F.translate(F.lower(bare), "abcdefghijklmnopqrstuvwxyz", "") != F.lower(bare), first_of(NAMED))
    )
    return parsed.cast("date")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value held inside [low, high]; NULL stays NULL."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def scale_col(value: Column, minimum: Column, maximum: Column) -> Column:
    return (value - minimum) / F.greatest(maximum - minimum, F.lit(SPAN_FLOOR))


def unscale_col(value: Column, minimum: Column, maximum: Column) -> Column:
    return value * F.greatest(maximum - minimum, F.lit(SPAN_FLOOR)) + minimum


def safe_name(text: Column) -> Column:
    """Text usable as a file or series name: other signs become `_`, outer `_` are cut."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def exact_sum(value: Column) -> Column:
    """Aggregate: sum in fixed point (18 decimals), the same for any order of rows and partitions."""
    return F.sum(value.cast("decimal(28,18)")).cast("double")


# Means and deviations over whole numbers of billionths; larger values than WIDE leave the fixed point.
UNITS, WIDE = 1e9, 9e9
HALF, FULL = Decimal(10**19), Decimal(9 * 10**37)


def fixed_units(value: Column) -> Column:
    """A double as a whole number of billionths; NULL for NULL, NaN and what is too large for it."""
    return F.when(F.abs(value) < WIDE, F.floor(value * UNITS + 0.5)).cast("decimal(19,0)")


def fixed_sums(value: Column) -> Column:
    """Aggregate: what `fixed_mean` and `fixed_std` need, the same for any order of rows and partitions.

    Sums of whole numbers and of their squares add without rounding. A group with a value beyond the
    fixed point keeps the float mean and deviation, as do squares whose sum has more than 38 digits.
    """
    units = fixed_units(value)
    return F.struct(
        F.count(units).alias("n"), F.sum(units).alias("s"), F.try_sum(units * units).alias("q"),
        F.bool_or(F.isnan(value) | (F.abs(value) >= WIDE)).alias("wide"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
    )


def fixed_mean(sums: Column) -> Column:
    """Mean of `fixed_sums`; NULL without a value."""
    exact = sums["s"].cast("double") / UNITS / F.when(sums["n"] > 0, sums["n"])
    return F.when(sums["wide"], sums["mean"]).otherwise(exact)


def fixed_std(sums: Column) -> Column:
    """Sample deviation of `fixed_sums`; NULL for fewer than two values.

    With s = m * n + r in whole numbers, the sum of squared deviations is (q - m * (s + r)) - r * r / n,
    whose large terms cancel exactly.
    """
    n = F.when(sums["n"] > 1, sums["n"])
    m, r = F.call_function("div", sums["s"], n), sums["s"] % n
    rest = sums["q"] - m.cast("decimal(19,0)") * (sums["s"] + r)
    # in two parts of at most 64 bits, whose doubles every engine rounds alike
    high, low = F.call_function("div", rest, F.lit(HALF)).cast("double"), (rest % F.lit(HALF)).cast("double")
    spread = (high * F.lit(1e19) + low - r.cast("double") * r.cast("double") / n) / (n - 1)
    exact = F.when(sums["n"] > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / UNITS)
    return F.when(sums["wide"] | sums["q"].isNull() | (sums["q"] >= F.lit(FULL)), sums["std"]).otherwise(exact)
