"""Small formats that reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reduction_label(mm: Column) -> Column:
    """Three decimals without trailing zeros; at least one decimal stays."""
    short = F.regexp_replace(F.format_string("%.3f", mm.cast("double")), "0+$", "")
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)


def _one_decimal(x: Column, unit: str) -> Column:
    """``x`` (finite, 1 to 2^53) to one decimal of its exact binary value, as printf and Python do: its fraction is a whole number of 2^-52, so the digit is found in whole numbers."""
    whole = F.floor(x)
    tenths = ((x - whole) * 2.0**52).cast("long") * 10
    digit = F.shiftright(tenths, 52)
    rest, half = tenths - F.shiftleft(digit, 52), F.lit(1 << 51)
    total = whole * 10 + digit
    total = total + ((rest > half) | ((rest == half) & (total % 2 == 1))).cast("long")
    return F.concat((total / 10).cast("long").cast("string"), F.lit("."), (total % 10).cast("string"), F.lit(unit))


def duration_label(seconds: Column) -> Column:
    """Whole seconds below 90, minutes below 5400 and hours from there on with a decimal: 89s, 1.5m, 2.0h. The exact value is rounded, not its shortest decimal form; halves go to the even digit."""
    s = seconds.cast("double")
    hours = F.when(s < 2.0**50, _one_decimal(s / 3600, "h")).otherwise(F.format_string("%.1fh", s / 3600))
    return F.when(s < 90, F.format_string("%.0fs", F.bround(s, 0))).when(s < 5400, _one_decimal(s / 60, "m")).otherwise(hours)
