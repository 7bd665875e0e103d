"""Column expressions with the null rules of the analysis.

A missing value is NULL, never NaN; a comparison with NULL is false where it makes a flag; a clip of
NULL is NULL, although ``greatest`` and ``least`` skip NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BEFORE_ALL = Window.unboundedPreceding


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def gated(value: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """``value`` where the frame has at least ``least`` non-null ``x``."""
    return F.when(F.count(x).over(w) >= least, value)


def rolled(f, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``f`` over the ``n`` rows before this one; NULL with fewer than ``least`` values."""
    w = w.rowsBetween(-n, -1)
    return gated(f(x).over(w), x, w, n if least is None else least)


def expanding(f, x: Column, w: WindowSpec, least: int = 1) -> Column:
    """``f`` over all rows before this one."""
    w = w.rowsBetween(BEFORE_ALL, -1)
    return gated(f(x).over(w), x, w, least)


def percent_rank(x: Column, *keys) -> Column:
    """Rank with average ties over the number of values, within ``keys``; NULL stays NULL."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    n = F.count(x).over(part)
    up, down = F.rank().over(part.orderBy(x.asc_nulls_last())), F.rank().over(part.orderBy(x.desc_nulls_last()))
    # equal values span the ranks up .. n - down + 1, so one partitioning serves ties too
    return F.when(x.isNotNull(), (up + n - down + 1) / 2.0 / n)


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once per row."""
    return F.transform(F.array(x), f)[0]


def shannon_entropy(values: Column, bins: int = 8) -> Column:
    """Entropy (ln) of an equal-width histogram of an array; 0 if all are equal, NULL below ``bins`` values."""
    lo, hi, n = F.array_min(values), F.array_max(values), F.size(values)
    # what a lambda reads is bound by an outer one, else it is made anew for each element
    place = _bound(F.struct(lo.alias("lo"), hi.alias("hi")), lambda b: F.transform(values, lambda v: F.least(F.lit(bins - 1), F.floor((v - b["lo"]) / (b["hi"] - b["lo"]) * bins).cast("int"))))
    counts = _bound(place, lambda at: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda p: p == b))))
    share = F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / n)
    total = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.ln(p))
    return F.when(n >= bins, F.when(hi > lo, total).otherwise(0.0))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th and so on."""
    teens = (n % 100).between(11, 13)
    end = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def parse_date(x: Column) -> Column:
    return F.to_date(F.try_to_timestamp(x))


def parse_number(x: Column) -> Column:
    return x.try_cast("double")
