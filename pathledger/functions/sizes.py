"""Human-readable sizes, read and written."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1024-based units, smallest first.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?"
_WITH_UNIT = rf"^({_NUMBER})\s*(PB|TB|GB|MB|KB|B)$"
_PLAIN = r"^[+-]?[0-9]+$"


def parse_size(text: str) -> int:
    """Bytes meant by an option such as ``1.5TB``; a bare number must be whole."""
    cleaned = text.strip().upper()
    sized = re.match(_WITH_UNIT, cleaned)
    if sized:
        return int(float(sized.group(1)) * 1024 ** UNITS.index(sized.group(2)))
    if re.match(_PLAIN, cleaned):
        return int(cleaned)
    raise ValueError(f"not a size: {text!r}")


def parse_size_column(text: Column) -> Column:
    """Column form of :func:`parse_size`; NULL where the text is not a size."""
    cleaned = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    unit = F.regexp_extract(cleaned, _WITH_UNIT, 2)
    number = F.regexp_extract(cleaned, _WITH_UNIT, 1).try_cast("double")
    factor = F.lit(None).cast("long")
    for power, name in enumerate(UNITS):
        factor = F.when(unit == name, F.lit(1024**power)).otherwise(factor)
    return (
        F.when(cleaned.rlike(_PLAIN), cleaned.try_cast("long"))
        .when(unit != "", (number * factor).try_cast("long"))
    )


def size_human(size: Column, missing: str | None = "N/A") -> Column:
    """One decimal and a unit, rounding ties to even.

    Whole-number arithmetic keeps the rounding exact at every magnitude, which
    formatting a double would not (the JVM rounds ties away from zero).
    """
    magnitude = F.abs(size)
    divisor, unit = F.lit(1024**5), F.lit("PB")
    for power in range(4, -1, -1):
        fits = magnitude < 1024 ** (power + 1)
        divisor = F.when(fits, F.lit(1024**power)).otherwise(divisor)
        unit = F.when(fits, F.lit(UNITS[power])).otherwise(unit)

    scaled = (magnitude % divisor) * 10
    whole, tenths = _div(magnitude, divisor), _div(scaled, divisor)
    rest = (scaled % divisor) * 2
    up = (rest > divisor) | ((rest == divisor) & (tenths % 2 == 1))
    rounded = whole * 10 + tenths + F.when(up, 1).otherwise(0)
    text = F.concat(
        F.when(size < 0, F.lit("-")).otherwise(F.lit("")),
        _div(rounded, F.lit(10)).cast("string"),
        F.lit("."),
        (rounded % 10).cast("string"),
        F.lit(" "),
        unit,
    )
    return text if missing is None else F.coalesce(text, F.lit(missing))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
