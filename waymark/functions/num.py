"""Numbers: clamping, ramps, decay, truncating division, renormalised weights and money."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: float, digits: int) -> float:
    """What F.round does to a double, for plain numbers: half away from zero, on its shortest decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def clamp(x: Column) -> Column:
    """x held within 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ramp(x: Column, low: Column | float, high: Column | float) -> Column:
    """0 below low, 1 above high, straight between; a step at `high` where the two do not ascend."""
    low, high = F.lit(low) if not isinstance(low, Column) else low, F.lit(high) if not isinstance(high, Column) else high
    return F.when(high <= low, F.when(x >= high, 1.0).otherwise(0.0)).otherwise(clamp((x - low) / (high - low)))


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / F.lit(float(half_life)))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def to_micros(usd: Column) -> Column:
    """US dollars as whole micro-dollars."""
    return F.round(usd * 1_000_000).cast("long")


def token_price(tokens: Column, micros_per_million: Column) -> Column:
    """Price of some tokens, truncated; the kinds of tokens of a call are priced apart and then added."""
    return int_div(tokens * micros_per_million, F.lit(1_000_000))


def renormalised(signals: dict[str, tuple[Column, float]], digits: int = 4) -> Column:
    """Weighted mean of the signals that are known: unknown ones drop out and the weights left are scaled to 1."""
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in signals.values()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in signals.values()), F.lit(0.0))
    return F.round(F.when(weight > 0, total / weight).otherwise(0.0), digits)


def missing(signals: dict[str, tuple[Column, float]]) -> Column:
    """Names of the signals that are null, in their order."""
    return F.filter(F.array(*[F.when(v.isNull(), F.lit(k)) for k, (v, _) in signals.items()]), lambda x: x.isNotNull())


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))
