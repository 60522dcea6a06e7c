"""Period summaries, catalogue statistics and seasonal profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import calendar as cal
from tidemark.functions.numeric import growth


def _last_where(rule: Column) -> Column:
    """Value of the newest valid row satisfying ``rule``."""
    hit = rule & F.col("v").isNotNull()
    return F.max_by(F.when(hit, F.col("v")), F.when(hit, F.col("d")))


def _references(freq: str, d: Column, cur: Column) -> dict[str, Column]:
    """Reference values each frequency compares its latest value with."""
    month = lambda back: F.trunc(d, "MM") == F.add_months(F.trunc(cur, "MM"), -back)
    quarter = lambda back: F.trunc(d, "QUARTER") == F.add_months(F.trunc(cur, "QUARTER"), -3 * back)
    mean = lambda n: F.avg(F.when((d >= F.date_sub(cur, n)) & (d < cur), F.col("v")))
    year_end = lambda back: _last_where(F.year(d) <= F.year(cur) - back)
    return {
        "D": lambda: {"previous": _last_where(d == F.date_sub(cur, 1)), "week_mean": mean(7), "month_mean": mean(30)},
        "W": lambda: {"previous": _last_where(d == F.date_sub(cur, 7))},
        "K": lambda: {"previous": _last_where(cal.dekad_number(d) == cal.dekad_number(cur) - 1)},
        "M": lambda: {"previous": _last_where(month(1)), "year_ago": _last_where(month(12))},
        "Q": lambda: {"previous": _last_where(quarter(1)), "year_ago": _last_where(quarter(4))},
        "Y": lambda: {"year_ago": year_end(1), "two_years_ago": year_end(2), "three_years_ago": year_end(3)},
    }[freq]()


def summarize(obs: DataFrame, freq: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Latest value of each series, its reference values and growth rates.

    The latest date is a window on the series and the references one grouped
    aggregation on the same key: a single shuffle.  Growth divides by the
    absolute reference, except monthly and quarterly ratios, and is a
    difference for per-cent units other than operating rates."""
    d, valid = F.col("d"), F.col("v").isNotNull()
    w = Window.partitionBy("series")
    dated = obs.filter(valid).withColumn("_cur", F.max("d").over(w))
    cur = F.col("_cur")
    refs = _references(freq, d, cur)
    out = dated.groupBy("series").agg(
        F.max("_cur").alias("latest_date"), F.max_by("v", "d").alias("latest"), *[e.alias(n) for n, e in refs.items()])
    difference = None
    if dictionary is not None:
        out = out.join(dictionary.select(F.col("name").alias("series"), "unit", "type", "industry"), "series", "left")
        difference = (F.coalesce("unit", F.lit("")) == vocab.PERCENT_UNIT) & (
            F.coalesce("type", F.lit("")) != vocab.OPERATING_RATE)
    absolute = freq not in ("M", "Q")
    if "previous" in refs:
        out = out.withColumn("growth", growth(F.col("latest"), F.col("previous"), absolute, difference))
    if "year_ago" in refs:
        out = out.withColumn("growth_year", growth(F.col("latest"), F.col("year_ago"), absolute, difference))
    return out


def breadth(daily_summary: DataFrame) -> DataFrame:
    """Counts and shares of rising, falling and above-mean indicators, with a sentence."""
    rise, fall = F.col("growth") > 0, F.col("growth") < 0
    week, month = F.col("latest") > F.col("week_mean"), F.col("latest") > F.col("month_mean")
    out = daily_summary.agg(F.count(F.lit(1)).alias("total"), F.count_if(rise).alias("rising"),
                            F.count_if(fall).alias("falling"), F.count_if(week).alias("above_week"),
                            F.count_if(month).alias("above_month"))
    names = ("rising", "falling", "above_week", "above_month")
    for n in names:
        out = out.withColumn(n + "_pct", F.coalesce(F.try_divide(F.col(n) * 100.0, F.col("total")), F.lit(0.0)))
    # Wording of the summary sentence.
    wording = ("共%d个指标，%d个上涨（占比%.1f%%），%d个下跌（占比%.1f%%）；"
               "%d个高于上周均值（占比%.1f%%），%d个高于上月均值（占比%.1f%%）。")
    return out.withColumn("sentence", F.format_string(
        wording, "total", *[c for n in names for c in (n, n + "_pct")]))


def catalogue_counts(indicators: DataFrame) -> DataFrame:
    """Distinct indicators per industry, per type and per frequency, in one pass."""
    named = indicators.select("name", F.coalesce("industry", F.lit(vocab.UNCLASSIFIED)).alias("industry"),
                              F.coalesce("type", F.lit(vocab.UNCLASSIFIED)).alias("type"), "freq")
    sets = [[F.col("industry")], [F.col("type")], [F.col("freq")]]
    out = named.groupingSets(sets, "industry", "type", "freq").agg(
        F.countDistinct("name").alias("n"), F.grouping_id("industry", "type", "freq").alias("gid"))
    dimension = F.when(F.col("gid") == 3, "industry").when(F.col("gid") == 5, "type").otherwise("freq")
    return out.select(dimension.alias("dimension"), F.coalesce("industry", "type", "freq").alias("label"), "n")


def counts_with_total(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, largest first, and a closing total row."""
    out = df.rollup(label).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).cast("int").alias("is_total"))
    return out.select(F.when(F.col("is_total") == 1, "合计").otherwise(F.col(label)).alias("label"), "n",
                      "is_total").orderBy("is_total", F.col("n").desc(), "label")


def coverage(obs: DataFrame) -> DataFrame:
    """Range, valid count and missing share against the frequency's calendar.

    Input carries ``freq``; only valid values define the range."""
    stats = obs.filter(F.col("v").isNotNull()).groupBy("series", "freq").agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("n_valid"))
    expected = cal.expected_points(F.col("first_date"), F.col("last_date"), F.col("freq"))
    return stats.withColumn("expected", expected).withColumn(
        "missing_pct", F.coalesce(F.try_divide((F.col("expected") - F.col("n_valid")) * 100.0, F.col("expected")), F.lit(0.0)))


def raw_quality(obs: DataFrame) -> DataFrame:
    """Missing share of raw series against span / nominal days; zero is missing."""
    live = F.col("v").isNotNull() & (F.col("v") != 0)
    stats = obs.groupBy("series", "freq").agg(
        F.min(F.when(live, F.col("d"))).alias("first_date"), F.max(F.when(live, F.col("d"))).alias("last_date"),
        F.count_if(live).alias("n_valid"))
    days = F.element_at(F.create_map(*[F.lit(x) for kv in vocab.NOMINAL_DAYS.items() for x in kv]), F.col("freq"))
    expected = F.greatest(F.ceil((F.datediff("last_date", "first_date") + 1) / days), F.lit(1))
    missing = F.greatest(F.col("expected") - F.col("n_valid"), F.lit(0)) * 100.0 / F.col("expected")
    return stats.withColumn("expected", expected.cast("long")).withColumn(
        "missing_pct", F.when(F.col("n_valid") == 0, 100.0).otherwise(missing))


def panel_quality(panel: DataFrame) -> DataFrame:
    """Missing and negative shares of a prepared panel's variables."""
    live = F.col("v").isNotNull() & (F.col("v") != 0)
    stats = panel.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(live).alias("n_valid"), F.count_if(live & (F.col("v") < 0)).alias("n_negative"),
        F.min(F.when(live, F.col("d"))).alias("first_date"), F.max(F.when(live, F.col("d"))).alias("last_date"))
    return stats.withColumn("missing_pct", (F.col("n_rows") - F.col("n_valid")) * 100.0 / F.col("n_rows")).withColumn(
        "negative_pct", F.coalesce(F.try_divide(F.col("n_negative") * 100.0, F.col("n_valid")), F.lit(0.0)))


def seasonal_profile(obs: DataFrame, freq: str, current_year: int) -> DataFrame:
    """Minimum, maximum and mean of each calendar period over all years, beside
    the current and previous calendar year's values.

    Bands include the two recent years.  Zeros are missing except for daily
    series, whose bands are filled forward and then backward.  Weeks are ISO
    weeks paired with the calendar year."""
    d = F.col("d")
    iso_weeks = date(current_year, 12, 28).isocalendar()[1]
    period, size = {"W": (F.weekofyear(d), iso_weeks), "M": (F.month(d), 12),
                    "K": ((F.month(d) - 1) * 3 + cal.dekad_of_month(d), 36),
                    "Q": (F.quarter(d), 4), "D": (F.dayofyear(d), 366)}[freq]
    v = F.col("v") if freq == "D" else F.nullif("v", F.lit(0.0))
    year = F.year(d)
    in_year = lambda y: F.max_by(F.when(year == y, F.col("v")), F.when(year == y, d))
    within = F.when(period <= size, period.cast("int"))
    stats = obs.withColumn("v", v).withColumn("_at", within).groupBy("series", "_at").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"),
        in_year(current_year).alias("current"), in_year(current_year - 1).alias("previous"))
    # Each period writes its own row and the empty ones up to the next, the first also those before it.
    w = Window.partitionBy("series").orderBy(F.col("_at").asc_nulls_first())
    start = F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_at"))
    placed = stats.withColumn("_from", start).withColumn("_to", F.coalesce(F.lead("_at").over(w) - 1, F.lit(size)))
    rows = placed.withColumn("period", F.explode(F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))))
    own = F.col("period") == F.col("_at")
    out = rows.select("series", "period", *[F.when(own, F.col(c)).alias(c) for c in ("low", "high", "mean", "current", "previous")])
    if freq == "D":
        ahead = Window.partitionBy("series").orderBy("period")
        back = Window.partitionBy("series").orderBy(F.col("period").desc())
        for c in ("low", "high", "mean"):
            out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(back)))
    return out
