"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from syncohort.settings import MISSING_STAGE

DAYS_PER_YEAR = 365.25


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def recode_missing(column: str | Column, code: int = MISSING_STAGE) -> Column:
    """Missing -> `code`."""
    return F.coalesce(as_column(column), F.lit(code))


def restore_missing(column: str | Column, codes: Iterable[int] = (MISSING_STAGE,)) -> Column:
    """Any of `codes` -> missing."""
    column = as_column(column)
    return F.when(column.isin(list(codes)), F.lit(None)).otherwise(column)


def recode(column: str | Column, mapping: Mapping[int, int]) -> Column:
    """Replace single codes, keep the rest."""
    column = as_column(column)
    out = column
    for old, new in mapping.items():
        out = F.when(column == F.lit(old), F.lit(new)).otherwise(out)
    return out


def year_group(year: str | Column, length: int = 2) -> Column:
    """First year of the `length`-year group."""
    year = as_column(year)
    return (year - F.pmod(year, F.lit(length))).cast("int")


def age_group(age: str | Column, cuts: Sequence[int] = (0, 40, 50, 60, 70, 80)) -> Column:
    """Index of the right-closed interval: 0 up to the first cut, and so on."""
    age = as_column(age)
    out = F.when(age <= cuts[0], F.lit(0))
    for index, cut in enumerate(cuts[1:], start=1):
        out = out.when(age <= cut, F.lit(index))
    return out.when(age.isNotNull(), F.lit(len(cuts)))


def bin_index(value: str | Column, width: str | Column) -> Column:
    """`floor(value / width)`; a zero width puts every value in bin 0."""
    width = as_column(width)
    return F.coalesce(F.floor(as_column(value) / F.nullif(width, F.lit(0.0))), F.lit(0))


def clip(value: str | Column, low: str | Column, high: str | Column) -> Column:
    value = as_column(value)
    return F.when(value.isNotNull(), F.greatest(F.least(value, as_column(high)), as_column(low)))


def parse_day(text: str | Column) -> Column:
    """`31dec2021` -> date."""
    return F.to_date(as_column(text), "ddMMMyyyy")


def format_day(day: str | Column) -> Column:
    """date -> `31dec2021`."""
    return F.lower(F.date_format(as_column(day), "ddMMMyyyy"))


def years_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(as_column(end), as_column(start)) / F.lit(DAYS_PER_YEAR)


def ratio(part: str | Column, whole: str | Column) -> Column:
    """Division that gives missing instead of an error for a zero denominator."""
    whole = as_column(whole).cast("double")
    return as_column(part).cast("double") / F.nullif(whole, F.lit(0.0))


def is_missing(value: str | Column) -> Column:
    value = as_column(value).cast("double")
    return value.isNull() | F.isnan(value)


def format_fixed(value: str | Column, digits: int = 3) -> Column:
    """Fixed decimals; missing is a dot."""
    value = as_column(value)
    return F.when(is_missing(value), F.lit(".")).otherwise(
        F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))
    )


def format_scientific(value: str | Column, digits: int = 1) -> Column:
    value = as_column(value)
    return F.when(is_missing(value), F.lit(".")).otherwise(
        F.format_string(f"%.{digits}e", value.cast("double"))
    )


def format_interval(middle: Column, low: Column, high: Column) -> Column:
    """`middle (low, high)` from three formatted texts."""
    return F.concat(middle, F.lit(" ("), low, F.lit(", "), high, F.lit(")"))


def decode(code: str | Column, labels: Mapping[int, str]) -> Column:
    """Code -> label text, missing when the code has no label."""
    pairs = [F.lit(part) for pair in sorted(labels.items()) for part in pair]
    return F.try_element_at(F.create_map(*pairs), as_column(code).cast("int"))


def log_sum_exp(values: Column) -> Column:
    """Stable `ln(sum(exp(x)))` over a numeric array; missing elements are skipped."""
    present = F.filter(values, lambda x: x.isNotNull())
    top = F.array_max(present)
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(F.size(present) > 0, top + F.ln(total))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def run_keys(columns: Iterable[str], keys: Iterable[str]) -> list[str]:
    """The keys that are present, in key order."""
    present = set(columns)
    return [key for key in keys if key in present]
