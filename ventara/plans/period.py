"""Selected and comparison periods, and the windows of a running month."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ventara.functions.text import col


def shift_month(day: date, months: int) -> date:
    """Same day another month, clamped to its last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def month_end(day: date) -> date:
    return day.replace(day=monthrange(day.year, day.month)[1])


def month_labels(start: date, end: date) -> list[str]:
    count = (end.year - start.year) * 12 + end.month - start.month + 1
    first = start.replace(day=1)
    return [f"{shift_month(first, i):%Y-%m}" for i in range(max(count, 0))] if start <= end else []


def next_labels(label: str, count: int) -> list[str]:
    first = date(int(label[:4]), int(label[5:7]), 1)
    return [f"{shift_month(first, i + 1):%Y-%m}" for i in range(count)]


@dataclass(frozen=True)
class Period:
    selected_start: date
    selected_end: date
    comparison_start: date
    comparison_end: date

    @property
    def days(self) -> int:
        return max((self.selected_end - self.selected_start).days + 1, 1)

    @property
    def labels(self) -> list[str]:
        return month_labels(self.selected_start, self.selected_end)

    @property
    def months(self) -> int:
        return max(len(self.labels), 1)

    @property
    def next_labels(self) -> list[str]:
        last = self.labels[-1] if self.labels else f"{self.selected_end:%Y-%m}"
        return next_labels(last, self.months)

    def in_selected(self, day="date") -> Column:
        return between(day, self.selected_start, self.selected_end)

    def in_comparison(self, day="date") -> Column:
        return between(day, self.comparison_start, self.comparison_end)


@dataclass(frozen=True)
class MonthWindow:
    """Month to date up to `as_of`, the same days one month and one year earlier, and the full months."""

    as_of: date

    @property
    def start(self) -> date:
        return self.as_of.replace(day=1)

    @property
    def previous_end(self) -> date:
        return shift_month(self.as_of, -1)

    @property
    def previous_start(self) -> date:
        return self.previous_end.replace(day=1)

    @property
    def previous_full_end(self) -> date:
        return month_end(self.previous_start)

    @property
    def year_ago_end(self) -> date:
        return shift_month(self.as_of, -12)

    @property
    def year_ago_start(self) -> date:
        return self.year_ago_end.replace(day=1)

    @property
    def year_ago_full_end(self) -> date:
        return month_end(self.year_ago_start)

    @property
    def elapsed(self) -> int:
        return self.as_of.day

    @property
    def days(self) -> int:
        return monthrange(self.as_of.year, self.as_of.month)[1]

    @property
    def remaining(self) -> int:
        return max(self.days - self.elapsed, 0)


def day(value: date) -> Column:
    return F.lit(value)


def between(column, start: date, end: date) -> Column:
    return col(column).between(day(start), day(end))


def resolve_period(fact: DataFrame, selected=None, comparison=None) -> Period:
    """Requested ranges, or the fact's own span and the same number of days just before it."""
    if not (selected and all(selected)):
        span = fact.agg(F.min("date"), F.max("date")).first()
        selected = (span[0], span[1])
    start, end = selected
    if not (comparison and all(comparison)):
        days = max((end - start).days + 1, 1)
        comparison = (start - timedelta(days=days), start - timedelta(days=1))
    return Period(start, end, *comparison)


def load_window(period: Period, running_month: bool = False) -> tuple[date, date]:
    """Dates to read: from the comparison start, and for month dashboards from the same month last year."""
    start = min(period.comparison_start, period.selected_start)
    if running_month:
        month = MonthWindow(period.selected_end)
        start = min(start, month.previous_start, month.year_ago_start)
    return start, period.selected_end


def context(months: DataFrame, selected=None, comparison=None) -> DataFrame:
    """The period in one row, from statistics of months (month, rows, first_date, last_date) and without a look at the data."""
    span = months.agg(F.min("first_date").alias("a"), F.max("last_date").alias("z"), F.sum("rows").alias("rows"))
    start = F.lit(selected[0]) if selected and all(selected) else F.col("a")
    end = F.lit(selected[1]) if selected and all(selected) else F.col("z")
    row = span.select(start.alias("selected_start"), end.alias("selected_end"), "rows").withColumn("days", F.greatest(F.date_diff("selected_end", "selected_start") + 1, F.lit(1)))
    before = (F.lit(comparison[0]), F.lit(comparison[1])) if comparison and all(comparison) else (F.date_sub("selected_start", F.col("days")), F.date_sub("selected_start", 1))
    count = (F.year("selected_end") - F.year("selected_start")) * 12 + F.month("selected_end") - F.month("selected_start") + 1
    return row.select("selected_start", "selected_end", before[0].alias("comparison_start"), before[1].alias("comparison_end"), "days", F.greatest(count, F.lit(1)).alias("months"), "rows")


def load_plan(months: DataFrame, period: Period, running_month: bool = False) -> DataFrame:
    """The window that has to be read, with the stored months that it touches and their rows: what a read of it costs."""
    start, end = load_window(period, running_month)
    near = months.filter(F.col("month").between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
    return near.agg(F.count("*").alias("months"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit(start).alias("load_start"), F.lit(end).alias("load_end"), "months", "rows")


def slice_dates(fact: DataFrame, start: date, end: date) -> DataFrame:
    return fact.filter(between("date", start, end))


def slice_history(fact: DataFrame, end: date) -> DataFrame:
    return fact.filter(F.col("date") <= day(end))
