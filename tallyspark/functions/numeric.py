"""Numbers: money rounding, and tolerant parsing of printed amounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text, as characters and as a pattern.
SPACES = " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
SPACE = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACES) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also within lambdas, where Catalyst shares nothing."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim_space(text), F.lit(""))


def _rounded(value: Column, scale: float) -> Column:
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    up = F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + F.lit(0.0)  # the sum turns -0.0 into 0.0
    return F.when(finite, up)


def round2(value: Column) -> Column:
    """Two decimals, half away from zero on the binary product; null for NaN and infinities."""
    return _rounded(value, 100.0)


def round3(value: Column) -> Column:
    return _rounded(value, 1000.0)


def to_float(text: Column) -> Column:
    """The first number of a printed amount, to two decimals; null if there is none.

    Grouping commas, the rupee sign, ``Rs`` and ``%`` are dropped; an amount in parentheses is
    negative. Booleans as text hold no number, so they are null too.
    """
    plain = text.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?\z")  # most amounts: nothing to trim, replace or search

    def printed(t: Column) -> Column:
        bare = F.regexp_replace(t, r"[,%₹]|Rs", "")
        number = F.nullif(F.regexp_extract(bare, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
        return let(number, lambda n: F.when(t.startswith("(") & t.endswith(")"), -F.abs(n)).otherwise(n))

    number = F.when(plain, text.try_cast("double")).otherwise(let(trim_space(text), printed))
    return F.when(text.isNotNull(), let(number, round2))


def to_money(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(to_float(text), F.lit(float(default)))


def digits_only(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def sum_of(array: Column) -> Column:
    """Left-to-right sum of an array of doubles; nulls count as 0."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def nearest_rank(values: Column, percent: float) -> Column:
    """Percentile by nearest rank on the sorted array: index percent / 100 * (n - 1), rounded half to even."""
    at = F.bround(F.lit(percent / 100.0) * (F.size(values) - 1), 0).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(0.0))
