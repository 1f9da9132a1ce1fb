"""Ratios of aggregates, rounded half away from zero on decimals, never on doubles.

A tie therefore rounds the same way at any data size and in any order of aggregation.
"""

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType


def _decimal(number: int | Decimal) -> Column:
    """A literal of the smallest decimal type that holds it."""
    return F.lit(Decimal(number))


def _lossless(value: Column, precision: int, scale: int) -> Column:
    """Whether DECIMAL(precision, scale) holds ``value`` with all its digits; TRUE for NULL.

    Digits are finer than the last place if they leave a remainder of it. Doubles have to be equal
    to the decimal they become.
    """
    cut = value.try_cast(f"decimal({precision},{scale})")
    same = F.when(
        F.typeof(value).isin("double", "float"), cut.cast("double") == value.cast("double")
    ).otherwise(value % _decimal(Decimal(1).scaleb(-scale)) == F.lit(0))
    return value.isNull() | (cut.isNotNull() & same)


def _checked(lossless: Column, value: Column) -> Column:
    return F.when(lossless, value).otherwise(
        F.raise_error(F.lit("a sum does not fit: too large or too many decimals"))
    )


def _ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """Quotient of two decimals with six places, rounded half away from zero: long division in two steps.

    The expression is written out wherever it is used, so it is kept short.
    """
    unit = _decimal(Decimal(1).scaleb(-places))
    rest = numerator % denominator
    whole = ((numerator - rest) / denominator).cast("decimal(32,0)")
    wide = rest * _decimal(10**places)
    left = wide % denominator
    steps = ((wide - left) / denominator).cast(f"decimal({places + 1},0)")
    away = F.when((numerator < 0) == (denominator < 0), unit).otherwise(-unit)
    up = F.when(F.abs(left) * _decimal(2) >= F.abs(denominator), away).otherwise(unit * F.lit(0))
    return (whole + steps * unit + up).cast(f"decimal(38,{places})")


def _ratio_of(numerator: Column, denominator: Column, places: int, times: int) -> Column:
    num = numerator.cast("decimal(38,6)") * _decimal(times)
    den = F.nullif(denominator.cast("decimal(38,6)"), _decimal(0))
    fits = _lossless(numerator, 38 if times == 1 else 36, 6) & _lossless(denominator, 38, 6)
    room = F.coalesce(F.abs(denominator) < _decimal(10 ** (32 - places)), F.lit(True))
    return _checked(fits & room, _ratio(num, den, places))


def exact_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """``numerator / denominator`` rounded to ``places``; NULL when the denominator is 0 or NULL.

    Both may be sums with up to six decimals; finer ones are an error. The quotient is found by long
    division on decimals, so it is exact for numerators below 10**32 and denominators
    below 10**(32 - places); larger ones are an error too.
    """
    return _ratio_of(numerator, denominator, places, 1)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; exact for parts below 10**30."""
    return _ratio_of(part, whole, places, 100)


def per_count(total: Column, count: Column, places: int) -> Column:
    """``total`` for each of ``count`` rows, rounded; NULL for no rows.

    ``total`` may have up to four decimals and 22 digits before the point; more are an error. The decimal
    quotient keeps 16 places. A quotient that is no tie is further than that from one for fewer than 10**14
    rows (10**12 with four decimals), so rounding it again is exact, and cheaper than ``exact_ratio``.
    """
    rows = F.nullif(count.cast("decimal(18,0)"), _decimal(0))
    return _checked(_lossless(total, 26, 4), F.round(total.cast("decimal(26,4)") / rows, places))


def mean(value: Column, places: int) -> Column:
    """Aggregate: rounded average that skips NULL."""
    return per_count(F.sum(value), F.count(value), places)


#: ``wide_mean`` adds up multiples of this and what is left of each value apart.
_HIGH = 10**15


def wide_mean(value: Column, places: int) -> Column:
    """Aggregate: ``mean`` of decimals whose sum may have more than 38 digits.

    Values may have up to 32 digits before and six after the point.
    """
    exact = _checked(_lossless(value, 38, 6), value.cast("decimal(38,6)"))
    left = exact % _decimal(_HIGH)
    high = F.sum(((exact - left) / _decimal(_HIGH)).cast("decimal(18,0)"))
    low = F.sum(left)
    rows = F.nullif(F.count(value).cast("decimal(18,0)"), _decimal(0))
    high_left = high % rows
    # Whole units of the mean, and what is left of the sum, between 0 and the rows; ties round away from zero.
    rest = high_left * _decimal(_HIGH) + low
    rest_left = F.pmod(rest, rows)
    whole = ((high - high_left) / rows).cast("decimal(18,0)") * _decimal(_HIGH) + (
        (rest - rest_left) / rows
    ).cast("decimal(20,0)")
    below = whole < 0
    part = _ratio(F.when(below, rows - rest_left).otherwise(rest_left).cast("decimal(38,6)"), rows, places)
    return F.when(below, whole + _decimal(1) - part).otherwise(whole + part).cast(f"decimal(38,{places})")


def mean_of(kind: DataType) -> Callable[[Column, int], Column]:
    """``mean``, or ``wide_mean`` for a decimal type whose sum could outgrow it."""
    wide = isinstance(kind, DecimalType) and (kind.precision > 28 or kind.scale > 4)
    return wide_mean if wide else mean


def _spread(count: Column, total: Column, squares: Column) -> Column:
    n = count.cast("decimal(19,0)")
    s = total.cast("decimal(22,3)")
    return n * squares.cast("decimal(28,6)") - s * s


def sample_variance(count: Column, total: Column, squares: Column, places: int) -> Column:
    """Variance with n-1, from count, sum and sum of squares of values with up to three
    decimals; NULL for one value."""
    n = count.cast("decimal(18,0)")
    return exact_ratio(_spread(count, total, squares), n * (n - F.lit(1)), places)


def variance(count: Column, total: Column, squares: Column) -> Column:
    """Population variance, unrounded, from count, sum and sum of squares of such values."""
    n = count.cast("decimal(18,0)")
    return _spread(count, total, squares).cast("double") / F.nullif(
        (n * n).cast("double"), F.lit(0.0)
    )
