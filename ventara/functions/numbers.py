"""Number parsing and the percent rules.

Three percent rules exist side by side and give different results for zero and negative bases,
so each has its own helper. Values stay unrounded; `to_tenth` is applied where a threshold is
compared, because the thresholds are defined on percentages with one decimal.
"""

from pyspark.sql import Column, functions as F

from ventara.functions.text import col

MEASURE = "decimal(38,6)"


def dbl(x) -> Column:
    return col(x).cast("double") if not isinstance(x, (int, float)) else F.lit(float(x))


# Marks that only group digits. A mark is one when the text's last mark is the other one; the
# lookahead finds that out in a single pass, so the cell is read once whatever its format.
_GROUPING = r"\.(?=.*,[^.]*$)|,(?=.*\.[^,]*$)| "
_PLAIN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _measure(text: Column, target: str) -> Column:
    """The number, NULL for a text that is none, and an error for a number that the type cannot hold."""
    value = text.try_cast(target)
    too_large = F.raise_error(F.concat(F.lit(f"number beyond {target}: "), text)).cast(target)
    return F.when(value.isNull() & text.rlike(_PLAIN), too_large).otherwise(value)


def parse_number(x, target: str = MEASURE) -> Column:
    """Locale number: with both marks present the last one is the decimal mark; a lone comma is one too."""
    return _measure(F.translate(F.regexp_replace(col(x).cast("string"), _GROUPING, ""), ",", "."), target)


def parse_erp_number(x, target: str = MEASURE) -> Column:
    """ERP number: as soon as there is a comma it marks decimals and every dot groups."""
    text = col(x).cast("string")
    return _measure(F.when(F.contains(text, F.lit(",")), F.translate(text, ",. ", ".")).otherwise(F.translate(text, " ", "")), target)


def first_number(*xs) -> Column:
    return F.coalesce(*[parse_erp_number(x) for x in xs])


def ratio(a, b) -> Column:
    """a / max(b, 1)."""
    return dbl(a) / F.greatest(dbl(b), F.lit(1.0))


def share_pct(part, total) -> Column:
    """part / max(total, 1) as a percentage."""
    return ratio(part, total) * 100


def pct_change(current, previous) -> Column:
    """Report rule: base zero gives 100 for a positive value, else 0; the base keeps its sign."""
    c, p = dbl(current), dbl(previous)
    return F.when(p == 0, F.when(c > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(
        (c - p) / F.nullif(p, F.lit(0.0)) * 100
    )


def pct_change_abs(current, previous) -> Column:
    """Dashboard rule: a base near zero gives 0 or 100; otherwise divide by the absolute base."""
    c, p = dbl(current), dbl(previous)
    tiny = F.lit(0.0001)
    return F.when(
        F.abs(p) < tiny, F.when(F.abs(c) < tiny, F.lit(0.0)).otherwise(F.lit(100.0))
    ).otherwise((c - p) / F.nullif(F.abs(p), F.lit(0.0)) * 100)


def to_tenth(x) -> Column:
    return F.round(col(x), 1)


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def moderated(trend) -> Column:
    """Growth factor of a projection: the trend clamped to ±20 and damped to 60 %."""
    return 1 + clamp(trend, -20.0, 20.0) * 0.6 / 100


def traffic_light(value, low: float, high: float) -> Column:
    """Green from `high`, yellow from `low`; with low > high the scale is inverted."""
    v = col(value)
    if low > high:
        return F.when(v < high, "green").when(v < low, "yellow").otherwise("red")
    return F.when(v >= high, "green").when(v >= low, "yellow").otherwise("red")
