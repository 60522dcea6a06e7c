"""Calendar column expressions: week-ending Fridays, dekads, period buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_UNIT = {"month": "MM", "quarter": "QUARTER", "year": "YEAR"}


def week_ending(d: Column, day: str = "FRI") -> Column:
    """Date of the first ``day`` on or after ``d``."""
    return F.next_day(F.date_sub(d, 1), day)


def nearest_friday(d: Column) -> Column:
    """Monday to Friday go to this week's Friday, weekends to the one before."""
    return F.date_add(d, F.lit(4) - F.weekday(d))


def _period_end(d: Column, period: str) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    return F.date_sub(F.add_months(F.trunc(d, PERIOD_UNIT[period]), months), 1)


def last_friday(d: Column, period: str = "month") -> Column:
    end = _period_end(d, period)
    return F.date_sub(end, (F.weekday(end) + 3) % 7)


def first_friday(d: Column, period: str = "month") -> Column:
    return week_ending(F.trunc(d, PERIOD_UNIT[period]))


def _clamp(target: Column, d: Column, period: str) -> Column:
    """Pull a Friday that left ``d``'s period back to that period's edge.

    Whole dates are compared, so 1 January on a weekend clamps forward to the
    first Friday of January."""
    unit = PERIOD_UNIT[period]
    return (F.when(F.trunc(target, unit) == F.trunc(d, unit), target)
            .when(target > d, last_friday(d, period))
            .otherwise(first_friday(d, period)))


def period_friday(d: Column, period: str | None) -> Column:
    """Nearest Friday inside the date's own month, quarter or year."""
    friday = nearest_friday(d)
    return friday if period is None else _clamp(friday, d, period)


def dekad_friday(d: Column) -> Column:
    """As the monthly rule, but a Monday belongs to the Friday before."""
    friday = F.when(F.weekday(d) == 0, F.date_sub(d, 3)).otherwise(nearest_friday(d))
    return _clamp(friday, d, "month")


def friday_with_lag(d: Column, lag_days: Column, period: str | None = "month") -> Column:
    """Friday near the publication date ``d + lag``, inside its period."""
    return period_friday(F.date_add(d, lag_days), period)


def dekad_of_month(d: Column) -> Column:
    return F.least(F.floor((F.day(d) - 1) / 10), F.lit(2)).cast("int") + 1


def is_dekad_date(d: Column) -> Column:
    return F.day(d).isin(10, 20) | (d == F.last_day(d))


def dekad_end(d: Column) -> Column:
    """10th, 20th or month end closing the dekad that holds ``d``."""
    start = F.trunc(d, "MM")
    return (F.when(F.day(d) <= 10, F.date_add(start, 9))
            .when(F.day(d) <= 20, F.date_add(start, 19)).otherwise(F.last_day(d)))


def dekad_number(d: Column) -> Column:
    """Running dekad count, consecutive across months."""
    return (F.year(d) * 12 + F.month(d)) * 3 + dekad_of_month(d)


def bucket(d: Column, label: str, origin: Column | None = None) -> Column:
    """Resampling bucket for an exploration frequency label.

    ``Ten_Day`` buckets count from ``origin``, the first date of the whole frame."""
    if label == "Daily":
        return d
    if label == "Weekly":
        return week_ending(d, "MON")
    if label == "Ten_Day":
        return F.date_add(origin, (F.floor(F.datediff(d, origin) / 10) * 10).cast("int"))
    period = {"Monthly": "month", "Quarterly": "quarter", "Annual": "year"}[label]
    return _period_end(d, period)


def next_bucket(b: Column, label: str) -> Column:
    """The bucket after ``b``."""
    days = {"Daily": 1, "Weekly": 7, "Ten_Day": 10}.get(label)
    if days:
        return F.date_add(b, days)
    months = {"Monthly": 1, "Quarterly": 3, "Annual": 12}[label]
    return F.last_day(F.add_months(b, months))


def bucket_sequence(lo: Column, hi: Column, label: str) -> Column:
    """Array of every bucket from ``lo`` to ``hi``."""
    days = {"Daily": 1, "Weekly": 7, "Ten_Day": 10}.get(label)
    if days:
        return F.sequence(lo, hi, F.expr(f"interval {days} days"))
    months = {"Monthly": 1, "Quarterly": 3, "Annual": 12}[label]
    steps = F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr(f"interval {months} months"))
    return F.transform(steps, F.last_day)


def friday_sequence(lo: Column, hi: Column) -> Column:
    """Array of the Fridays in ``[lo, hi]``; empty when there is none."""
    first = week_ending(lo)
    return F.when(first <= hi, F.sequence(first, hi, F.expr("interval 7 days"))).otherwise(
        F.array().cast("array<date>"))


def previous_month_end(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "MM"), 1)


def month_bounds(d: Column) -> tuple[Column, Column]:
    return F.trunc(d, "MM"), F.last_day(d)


def step_back(d: Column, freq: Column, periods: int = 1) -> Column:
    """``periods`` steps before ``d`` for frequency codes D, W, 10D and M.

    Months are stepped one at a time, so 31 May back two months is 30 March
    only if April shortened it first."""
    months = reduce(lambda acc, _: F.add_months(acc, -1), range(periods), d)
    return (F.when(freq == "D", F.date_sub(d, periods))
            .when(freq == "W", F.date_sub(d, 7 * periods))
            .when(freq == "10D", F.date_sub(d, 10 * periods))
            .when(freq == "M", months))


def auto_validation_start(observation_start: Column, freq: Column) -> Column:
    """Validation opens one period before observation."""
    return step_back(observation_start, freq)


def train_end(algorithm: Column, validation_start: Column, observation_start: Column,
              freq: Column) -> Column:
    """Last training day: the day before validation (or before the automatic one)."""
    start = F.when(algorithm == "deep_learning", step_back(observation_start, freq)).otherwise(
        validation_start)
    return F.date_sub(start, 1)


def date_range_error(algorithm: Column, training_start: Column, validation_start: Column,
                     observation_start: Column, freq: Column) -> Column:
    """Null when training precedes its limit, else a reason code."""
    limit = F.when(algorithm == "deep_learning", step_back(observation_start, freq)).otherwise(
        validation_start)
    return F.when(training_start >= limit, F.lit("training_start_not_before_limit"))


def expected_points(lo: Column, hi: Column, freq: Column) -> Column:
    """Observations a complete series would have between two dates."""
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    value = (F.when(freq == "D", F.datediff(hi, lo) + 1)
             .when(freq == "W", F.floor(F.datediff(hi, lo) / 7) + 1)
             .when(freq == "K", dekad_number(hi) - dekad_number(lo) + 1)
             .when(freq == "M", months + 1)
             .when(freq == "Q", (F.year(hi) - F.year(lo)) * 4 + F.quarter(hi) - F.quarter(lo) + 1)
             .when(freq == "Y", F.year(hi) - F.year(lo) + 1)
             .otherwise(0))
    return value.cast("long")
