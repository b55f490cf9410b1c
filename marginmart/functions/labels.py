"""Display labels as Column expressions.

They run at the edge of a report, on aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(x: Column, digits: int) -> Column:
    """A number with that many decimals and no thousands separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def month_label(ts: str | Column) -> Column:
    """``Oct 24``."""
    return F.date_format(_c(ts), "MMM yy")


def money(x: str | Column) -> Column:
    """``$1,234`` / ``-$1,234``; null shows as an em dash."""
    v = _c(x).cast("double")
    return (F.when(v.isNull() | F.isnan(v), F.lit("—"))
            .otherwise(F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                                F.format_number(F.abs(v), 0))))


def pct(x: str | Column, signed: bool = False) -> Column:
    """``12.3%`` (``+12.3%`` when signed, no thousands separators); null shows as an em dash."""
    v = _c(x).cast("double")
    sign = F.when(v >= 0, F.lit("+")).otherwise(F.lit("-")) if signed else F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(v.isNull() | F.isnan(v), F.lit("—"))
            .otherwise(F.concat(sign, _plain(F.abs(v), 1), F.lit("%"))))


def integer(x: str | Column) -> Column:
    """``1,234``."""
    v = _c(x).cast("double")
    return F.when(v.isNull(), F.lit("—")).otherwise(
        F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.format_number(F.abs(v), 0)))


def compact_money(x: str | Column) -> Column:
    """``$1.2M`` / ``$45K`` / ``$850``, no thousands separators; empty for 0, null or non-finite."""
    v = _c(x).cast("double")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    body = (F.when(a >= 1e6, F.concat(F.lit("$"), _plain(a / 1e6, 1), F.lit("M")))
            .when(a >= 1e3, F.concat(F.lit("$"), _plain(a / 1e3, 0), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), _plain(a, 0))))
    bad = v.isNull() | F.isnan(v) | (a == F.lit(float("inf"))) | (v == 0)
    return F.when(bad, F.lit("")).otherwise(F.concat(sign, body))


def gradient_position(x: str | Column, lo: Column, hi: Column, low_is_good: bool = False) -> Column:
    """X11: clamp((v - lo) / (hi - lo)) to [0, 1], inverted when low is good."""
    v = _c(x).cast("double")
    p = F.when(hi > lo, F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    return (1 - p) if low_is_good else p


def diverging_position(x: str | Column, bound: Column) -> Column:
    """X11: 0.5 + v / bound / 2, clamped to [0, 1]."""
    v = _c(x).cast("double")
    return F.when(bound > 0, F.least(F.greatest(0.5 + v / bound / 2, F.lit(0.0)), F.lit(1.0)))


def clip(x: str | Column, lo: Column, hi: Column) -> Column:
    """X12."""
    return F.least(F.greatest(_c(x), lo), hi)


def break_even_side(profit: str | Column = "Profit") -> Column:
    """True on the profit side of the break-even line."""
    return _c(profit) >= 0


def round_table(df, money=(), pct=(), money_digits: int = 2, pct_digits: int = 1):
    """Round money columns to 2 and percent columns to 1 digit, at the edge only."""
    from pyspark.sql import functions as F
    cols = []
    for c in df.columns:
        if c in money:
            cols.append(F.round(F.col(c), money_digits).alias(c))
        elif c in pct:
            cols.append(F.round(F.col(c), pct_digits).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def month_key_text(c: str | Column) -> Column:
    """First seven characters of an ISO date text (``2024-10``); E7 is used instead
    wherever a parsed timestamp exists."""
    return F.substring(_c(c), 1, 7)
