"""Period codes: 2024Q3 and 2024 (tables), Q3_2024 and FY_2024 (filings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER_LABEL = r"^Q(\d{1,2})_(\d{4})$"
YEAR_LABEL = r"^FY_(\d{4})$"


def to_code(period: Column) -> Column:
    """Q3_2024 to 2024Q3 and FY_2024 to 2024; anything else, such as 2024, stays as it is."""
    return F.regexp_replace(F.regexp_replace(period, QUARTER_LABEL, "$2Q$1"), YEAR_LABEL, "$1")


def _parts(period: Column) -> tuple[Column, Column]:
    code = to_code(period)
    return F.regexp_extract(code, r"^(\d{4})(?:Q\d{1,2})?$", 1), F.regexp_extract(code, r"^\d{4}Q(\d{1,2})$", 1)


def sort_key(period: Column) -> Column:
    """year * 100 + quarter, a whole year after its quarters; null for other strings. A company with many filings in a year has
    labels beyond Q4, since they number its filings."""
    year, quarter = _parts(period)
    return F.when(year != "", year.cast("int") * 100 + F.when(quarter != "", quarter.cast("int")).otherwise(99))


def start_date(period: Column) -> Column:
    """First day of a quarter or year; null for other strings and quarters beyond the fourth."""
    year, quarter = _parts(period)
    month = F.when(quarter != "", quarter.cast("int") * 3 - 2).otherwise(1)
    return F.when((year != "") & (month <= 12) & (month >= 1), F.make_date(year.cast("int"), month, F.lit(1)))


def code_of(date: Column, timeframe: str) -> Column:
    """The code of the period that a date lies in: 2024-07-03, 2024-07-01 (Monday), 2024-07, 2024Q3 or 2024."""
    if timeframe == "daily":
        return F.date_format(date, "yyyy-MM-dd")
    if timeframe == "weekly":
        return F.date_format(F.date_trunc("week", date), "yyyy-MM-dd")
    if timeframe == "monthly":
        return F.date_format(date, "yyyy-MM")
    if timeframe == "quarterly":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    if timeframe == "yearly":
        return F.year(date).cast("string")
    raise ValueError(f"unknown timeframe: {timeframe}")


def trunc_to(date: Column, timeframe: str) -> Column:
    unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(timeframe)
    if unit is None:
        raise ValueError(f"unknown timeframe: {timeframe}")
    return F.date_trunc(unit, date).cast("date")


def labels(years: Column, quarters: Column) -> Column:
    """Filing labels of every year and quarter, year by year; FY labels without quarters; none without years."""
    each = F.flatten(F.transform(years, lambda y: F.transform(quarters, lambda q: F.concat(q, F.lit("_"), y.cast("string")))))
    whole = F.transform(years, lambda y: F.concat(F.lit("FY_"), y.cast("string")))
    none = F.array().cast("array<string>")
    years_n, quarters_n = F.coalesce(F.size(years), F.lit(0)), F.coalesce(F.size(quarters), F.lit(0))
    return F.when((years_n > 0) & (quarters_n > 0), each).when(years_n > 0, whole).otherwise(none)
