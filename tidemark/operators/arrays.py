"""Series as date-ordered arrays, the hand-over format to numeric helpers.

An array holds at most one value per calendar date, so its length is bounded
by the calendar however many raw rows a series has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread


def dated(valid_only: bool = True) -> Column:
    row = F.struct("d", "v")
    return F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), row) if valid_only else row))


def values(dated_array: Column) -> Column:
    return F.transform(dated_array, lambda x: x["v"])


def series_arrays(obs: DataFrame, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Valid values of each series in date order."""
    return spread(obs, *keys).groupBy(*keys).agg(dated().alias("_dv")).select(*keys, values(F.col("_dv")).alias("values"))


def target_array(obs: DataFrame, target: str) -> Column:
    """One series' dated array as a scalar column, usable on every row."""
    return obs.filter(F.col("series") == target).select(dated()).scalar()


def target_sample(obs: DataFrame, target: str) -> list[float]:
    """One series' valid values in date order on the driver, no more than the
    calendar has dates, for a broadcast variable: sent once to each executor."""
    one = obs.filter(F.col("series") == target).agg(dated().alias("dv")).select(values(F.col("dv")).alias("v"))
    return list(one.first()["v"])
