"""Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from punctual.schemas import (
    RISK_HIGH, RISK_LOW, RISK_LOW_BELOW, RISK_MEDIUM, RISK_MEDIUM_BELOW,
)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round a double half away from zero on its binary value."""
    scale = F.lit(float(10 ** digits))
    number = value.cast("double")
    return F.signum(number) * F.floor(F.abs(number) * scale + F.lit(0.5)) / scale


def lenient_date(value: Column) -> Column:
    """Date, or NULL when the raw value does not parse."""
    return value.try_cast("date")


def whole_number(value: Column) -> Column:
    """BIGINT by rounding to the nearest even integer, not by truncation."""
    return F.rint(value.cast("double")).cast("bigint")


def yes_flag(value: Column) -> Column:
    """TRUE for yes / true / 1 in any case; FALSE for anything else and NULL."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("yes", "true", "1"), F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start).cast("bigint")


def share(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded; NULL when whole is zero."""
    return half_up(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def category_code(value: Column) -> Column:
    """Stable number for a category: the first 8 hex digits of its SHA-256."""
    text = F.regexp_replace(
        F.coalesce(value.cast("string"), F.lit("UNKNOWN")), r"(?U)^\s+|\s+$", ""
    )
    return F.conv(F.substring(F.sha2(F.lower(text), 256), 1, 8), 16, 10).cast("bigint")


def risk_level(risk: Column) -> Column:
    return (
        F.when(risk < RISK_LOW_BELOW, RISK_LOW)
        .when(risk < RISK_MEDIUM_BELOW, RISK_MEDIUM)
        .otherwise(RISK_HIGH)
    )


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("double"))


def percent_text(rate: Column) -> Column:
    """0.1235 -> '12.4%'; NULL counts as zero."""
    return F.format_string("%.1f%%", half_up(zero_if_null(rate) * F.lit(100.0), 1))


def one_decimal_text(value: Column) -> Column:
    return F.format_string("%.1f", half_up(zero_if_null(value.cast("double")), 1))


def count_text(value: Column) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")).cast("string")


def thousands_text(value: Column) -> Column:
    """1234567.8 -> '1,234,568'."""
    return F.format_number(half_up(zero_if_null(value.cast("double")), 0).cast("bigint"), 0)
