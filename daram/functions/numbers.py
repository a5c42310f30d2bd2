"""Column functions for exact amounts, Korean money units and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of Korean money in won, longest first.
UNITS = (("억", 100_000_000), ("천만", 10_000_000), ("백만", 1_000_000), ("만", 10_000), ("천", 1_000))


def cents(c: Column) -> Column:
    """A double amount as whole cents."""
    return F.round(c * 100).cast("bigint")


def half_up(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to the nearest integer, halves up, all in integers; null for a denominator of 0. For amounts of at least 0."""
    d = F.nullif(denominator, F.lit(0))
    return _div(numerator * 2 + d, d * 2)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def int_percent(part: Column, whole: Column) -> Column:
    """Truncated percentage; null for an empty whole."""
    return _div(part * 100, F.nullif(whole, F.lit(0)))


def won(text: Column) -> Column:
    """Amount in won of a text such as ``3,500만원``, ``9억원`` or ``67,000,000원``; null without a unit."""
    found = F.regexp_extract(text, r"(?<![\d,])([\d,]++)\s*+(억|천만|백만|만|천)?\s*원", 1)
    unit = F.regexp_extract(text, r"(?<![\d,])([\d,]++)\s*+(억|천만|백만|만|천)?\s*원", 2)
    number = F.regexp_replace(found, ",", "").try_cast("bigint")
    factor = F.lit(1)
    for name, value in UNITS:
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return number * factor.cast("bigint")


def won_by_hint(number: Column, hint: Column) -> Column:
    """Won of a bare number by what stands around it: a unit of 만 for the whole table, a price per 구좌, 만원, or nothing and a small number, which counts as 만원."""
    n = F.replace(number, F.lit(","), F.lit("")).try_cast("bigint")
    hint = F.coalesce(hint, F.lit(""))
    each = F.replace(F.regexp_extract(hint, r"1\s*구좌[^0-9]*([0-9,]+)\s*만원", 1), F.lit(","), F.lit("")).try_cast("bigint")
    man = n * 10_000
    return (
        F.when(hint.contains("가입단위") & hint.contains("만"), man).when(hint.contains("구좌"), F.coalesce(each * 10_000 * n, man))
        .when(hint.contains("만원") | (~hint.contains("원") & (n < 10_000)), man).otherwise(n)
    )


def money_display(amount: Column) -> Column:
    """Won as 억 and 만: ``1억 5000만원``."""
    eok, man = _div(amount, F.lit(100_000_000)), _div(F.pmod(amount, F.lit(100_000_000)), F.lit(10_000))
    return (
        F.when(amount.isNull(), None).when((eok > 0) & (man > 0), F.concat(eok.cast("string"), F.lit("억 "), man.cast("string"), F.lit("만원")))
        .when(eok > 0, F.concat(eok.cast("string"), F.lit("억원"))).when(man > 0, F.concat(man.cast("string"), F.lit("만원")))
        .otherwise(F.concat(amount.cast("string"), F.lit("원")))
    )


def band(value: Column, upper: list[int], unit: str = "") -> Column:
    """Label of the first band whose upper bound holds the value: ``60이하``, ``61~65``, and ``81이상`` beyond the last."""
    label = F.when(value.isNull(), None).when(value <= upper[0], f"{upper[0]}{unit}이하")
    for low, high in zip(upper, upper[1:]):
        label = label.when(value <= high, f"{low + 1}~{high}{unit}")
    return label.otherwise(f"{upper[-1] + 1}{unit}이상")
