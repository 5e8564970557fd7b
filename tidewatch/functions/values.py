"""Null-preserving column helpers. Missing is null: never zero, never a mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text, and the shape of one that cannot overflow.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PLAIN_NUMBER = r"^\s*[+-]?(\d{1,200}\.?\d*|\.\d+)([eE][+-]?\d{1,2})?\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once, for values built from array lambdas.

    Spark does not share subexpressions across lambdas, so naming one twice would run it twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c: Column | str) -> Column:
    """NaN and the infinities become null."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def non_negative(c: Column | str) -> Column:
    c = clean(c)
    return F.when(c >= 0, c)


def positive(c: Column | str) -> Column:
    c = clean(c)
    return F.when(c > 0, c)


def number(c: Column | str) -> Column:
    """Lenient parse of a text number; junk is null, and so is a value that overflows."""
    c = as_col(c)
    value = F.trim(c).try_cast("double")
    return F.when(c.rlike(PLAIN_NUMBER), value).when(c.rlike(NUMERIC_TEXT), clean(value))


def whole(c: Column | str) -> Column:
    """Lenient parse, truncated toward zero."""
    return number(c).try_cast("bigint")


def flag(c: Column | str) -> Column:
    """Three-state reading of a text flag."""
    t = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def percent(c: Column | str) -> Column:
    """A text fraction as a percentage."""
    return number(c) * 100.0


def to_ms(c: Column | str) -> Column:
    """ISO text to epoch milliseconds; text without an offset is UTC."""
    text = F.trim(as_col(c))
    return F.unix_millis(F.try_to_timestamp(F.when(text != "", text)))


def millis(ts: Column | str) -> Column:
    """A timestamp column to epoch milliseconds, truncated."""
    return F.expr("unix_micros(cast(__t as timestamp)) div 1000".replace("__t", ts)) if isinstance(
        ts, str
    ) else F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("bigint")


def div(a: Column | str, b: Column | str) -> Column:
    """a / b; null for a missing side, a zero denominator or a non-finite result."""
    a, b = clean(a), clean(b)
    return clean(F.when(b != 0, F.try_divide(a, b)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b only where the total is above zero."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.when(b > 0, F.try_divide(a, b))


def pressure(buys: Column | str, sells: Column | str) -> Column:
    """Buys over all trades of one window, when both counts are known."""
    b, s = as_col(buys).cast("double"), as_col(sells).cast("double")
    return ratio(b, b + s)


def window_ratio(short: Column, short_hours: float, long: Column, long_hours: float):
    """(short rate over long rate, saturated flag) for nested windows."""
    slow = ratio(long, F.lit(long_hours))
    r = F.when(slow > 0, F.try_divide(ratio(short, F.lit(short_hours)), slow))
    return r, F.coalesce(r >= long_hours / short_hours - 1e-9, F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def scale(c: Column | str, low: float, high: float) -> Column:
    """Linear map between two anchors onto 0..100."""
    return clamp((as_col(c).cast("double") - low) / (high - low) * 100.0)


def mean_of(*parts: Column) -> Column:
    """Mean over the parts that exist; null when none does."""
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.try_divide(total, known(*parts))


def known(*parts: Column) -> Column:
    """How many of the parts are not null."""
    return reduce(lambda x, y: x + y, [p.isNotNull().cast("int") for p in parts])


def age_minutes(now: Column | str, then: Column | str) -> Column:
    """Whole minutes between two epoch-ms columns; null if unknown or negative."""
    gap = as_col(now) - as_col(then)
    return F.when(gap >= 0, F.floor(gap / 60000).cast("bigint"))


def minutes_between(now: Column | str, then: Column | str) -> Column:
    return F.floor((as_col(now) - as_col(then)) / 60000).cast("bigint")


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) for an empty sample."""
    n, p = total.cast("double"), F.try_divide(successes.cast("double"), total.cast("double"))
    z2 = z * z
    d = 1 + F.try_divide(F.lit(z2), n)
    mid = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), d)
    half = F.try_divide(
        z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)), d
    )
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))
    return low, high


def auc_interval(auc: Column, pos: Column, neg: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Hanley-McNeil interval; perfect separation falls back to Wilson on the pairs."""
    p, n, a = pos.cast("double"), neg.cast("double"), auc
    q1 = F.try_divide(a, 2.0 - a)
    q2 = F.try_divide(2.0 * a * a, 1.0 + a)
    var = F.try_divide(
        a * (1.0 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a), p * n
    )
    wl, _ = wilson(p * n, p * n, z)
    half = z * F.sqrt(F.when(var > 0, var))
    ok = a.isNotNull() & (p >= 1) & (n >= 1)
    low = F.when(ok & (var <= 0), F.when(a >= 0.5, wl).otherwise(0.0)).when(
        ok, F.greatest(F.lit(0.0), a - half)
    )
    high = F.when(ok & (var <= 0), F.when(a >= 0.5, 1.0).otherwise(1.0 - wl)).when(
        ok, F.least(F.lit(1.0), a + half)
    )
    return low, high


def mcap_band(c: Column | str) -> Column:
    """Half-open market-cap bands used by the base-rate report."""
    c = as_col(c)
    return (
        F.when((c >= 0) & (c < 500_000), "<500k")
        .when((c >= 500_000) & (c < 2_000_000), "500k-2m")
        .when((c >= 2_000_000) & (c < 10_000_000), "2m-10m")
        .when(c >= 10_000_000, ">10m")
    )


def age_band(c: Column | str) -> Column:
    """Half-open age bands (minutes) used as strata."""
    c = as_col(c)
    return (
        F.when((c >= 0) & (c < 60), "<1h")
        .when((c >= 60) & (c < 360), "1-6h")
        .when((c >= 360) & (c < 2880), "6-48h")
        .when(c >= 2880, ">48h")
    )


def outcome(value: Column | str, threshold: float | None = None) -> Column:
    """A label column as 1/0; null while unresolved. A multiple needs a threshold."""
    value = as_col(value)
    hit = value if threshold is None else value >= threshold
    return F.when(value.isNotNull(), hit.cast("int"))
