"""Small text, number, date and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def codes(c: Column, separator: str = "/") -> Column:
    """The parts of a compound code, trimmed; null has none."""
    return F.transform(F.split(c, separator), lambda x: F.trim(x))


def slot_name(prefix: Column, day_type: Column, hour: Column) -> Column:
    """<prefix>_<first part of the day type in lower case>_<hour of two digits>."""
    return F.concat_ws("_", prefix, F.lower(F.element_at(F.split(day_type, "/"), 1)), F.lpad(hour.cast("string"), 2, "0"))


def number_key(c: Column) -> Column:
    """0.15 -> 0p15."""
    return F.replace(F.format_string("%.2f", c.cast("double")), F.lit("."), F.lit("p"))


def tile_key(c: Column) -> tuple[Column, Column]:
    """x_y as two numbers, 10**18 where a part is none."""
    part = lambda i: F.coalesce(F.expr("1").cast("long") * F.get(F.split(c, "_"), F.lit(i)).try_cast("long"), F.lit(10**18))
    return part(0), part(1)


def from_day_of_year(year: Column, day: Column, hour: Column, minute: Column) -> Column:
    first = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return first + F.make_dt_interval(day - 1, hour, minute)


def log_bin(v: Column, most: Column, bins: int = 6) -> Column:
    return F.least(F.lit(bins - 1), F.floor(F.log(v + 1) / F.log(most + 1) * bins)).cast("int")


def half_decade(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(8), F.floor((F.log10(F.greatest(v, F.lit(1e-9))) + 1) / 0.5))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """A vector over its length; a vector of zeros gives nulls."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(a, a))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def rolling_max(a: Column, reach: int = 1) -> Column:
    """Centred maximum over an array; clamped, not circular, at its ends."""
    return F.transform(a, lambda x, i: F.array_max(F.slice(a, F.greatest(F.lit(1), i + 1 - reach), F.least(F.size(a), i + 1 + reach) - F.greatest(F.lit(1), i + 1 - reach) + 1)))


def snap(c: Column, step: float = 0.05) -> Column:
    """Cluster key: the number of steps, half even."""
    return F.bround(c / step).cast("long")


def percent_byte(c: Column) -> Column:
    """A share as 0..100: missing counts as 1, times 100, clipped, truncated."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(1.0)), F.lit(1.0)) * 100)).cast("int")
