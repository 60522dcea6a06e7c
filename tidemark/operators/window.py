"""Differences, trends, gaps, running and trailing aggregates per series."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text


def by_date():
    return Window.partitionBy("series").orderBy("d")


def whole():
    return Window.partitionBy("series")


def diff_lag(obs: DataFrame, periods: int = 1) -> DataFrame:
    """Value minus the value ``periods`` rows earlier."""
    return obs.withColumn("v", F.col("v") - F.lag("v", periods).over(by_date()))


def diff_order(obs: DataFrame, order: int = 1, use_log: bool = False) -> DataFrame:
    """k-th order difference as one binomial sum; the first k rows disappear."""
    base = F.when(F.col("v") > 0, F.ln("v")) if use_log else F.col("v")
    logged = obs.withColumn("_b", base)
    terms = [F.lag("_b", i).over(by_date()) * float((-1) ** i * comb(order, i)) if i else F.col("_b")
             for i in range(order + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return (logged.withColumn("v", total).withColumn("_p", F.row_number().over(by_date()))
            .filter(F.col("_p") > order).drop("_b", "_p"))


def log_values(obs: DataFrame) -> DataFrame:
    """Natural log; ``log1p`` when the smallest value is zero; null for a series
    with a negative value, which :func:`log_errors` reports."""
    low = F.min("v").over(whole())
    return obs.withColumn("v", F.when(low > 0, F.ln("v")).when(low == 0, F.log1p("v")))


def log_errors(obs: DataFrame) -> DataFrame:
    """Series that have no logarithm because a value is negative."""
    return obs.groupBy("series").agg(F.min("v").alias("lowest")).filter("lowest < 0")


def _apply_op(obs: DataFrame, op: str, chosen: Column, year_rows: int) -> DataFrame:
    low = F.min(F.when(chosen, F.col("v"))).over(whole())
    new = {"log": F.when(low > 0, F.ln(F.when(F.col("v") > 0, F.col("v")))).when(low == 0, F.log1p(F.when(F.col("v") > -1, F.col("v")))),
           "diff_1": F.col("v") - F.lag("v", 1).over(by_date()),
           "diff_yoy": F.col("v") - F.lag("v", year_rows).over(by_date())}[op]
    return obs.withColumn("v", F.when(chosen, new).otherwise(F.col("v")))


#: Operations in one chain; each is a window over the same partitioning.
MOST_OPS = 24


def transform(obs: DataFrame, config: DataFrame, freq: str = "W-FRI") -> DataFrame:
    """Run each variable's own chain of ``log``, ``diff_1`` and ``diff_yoy``.

    ``config(variable, zero_method, ops)`` is joined by name.  The plan has as
    many steps as the longest chain, all on the same partitioning; a chain of
    more than ``MOST_OPS`` operations is an error."""
    longest = config.agg(F.max(F.size(F.filter("ops", lambda o: o != "none")))).first()[0] or 0
    if longest > MOST_OPS:
        raise ValueError(f"a chain has {longest} operations; at most {MOST_OPS} are allowed")
    rows = vocab.YEAR_ROWS.get(freq, 52)
    joined = obs.join(config.select(F.col("variable").alias("series"), "zero_method",
                                    F.filter("ops", lambda o: o != "none").alias("_ops")), "series", "left")
    zero = (F.when((F.col("v") == 0) & (F.col("zero_method") == "missing"), None)
            .when((F.col("v") == 0) & (F.col("zero_method") == "adjust"), F.lit(1.0)).otherwise(F.col("v")))
    out = joined.withColumn("original", F.col("v")).withColumn("v", zero)
    for step in range(longest):
        here = F.get(F.col("_ops"), F.lit(step))
        for op in ("log", "diff_1", "diff_yoy"):
            out = _apply_op(out, op, F.coalesce(here == op, F.lit(False)), rows)
    return out.select(*obs.columns, "original")


def transform_summary(transformed: DataFrame) -> DataFrame:
    """Moments and null counts of each variable before and after its chain."""
    def facts(col, tag):
        return [F.avg(col).alias(f"mean_{tag}"), F.stddev_samp(col).alias(f"std_{tag}"),
                F.min(col).alias(f"min_{tag}"), F.max(col).alias(f"max_{tag}"),
                (F.count(F.lit(1)) - F.count(col)).alias(f"nulls_{tag}")]
    return transformed.groupBy("series").agg(*facts("original", "before"), *facts("v", "after"))


def operation_counts(config: DataFrame) -> DataFrame:
    """How many variables use each operation."""
    return (config.select(F.explode("ops").alias("op")).filter("op <> 'none'")
            .groupBy("op").agg(F.count(F.lit(1)).alias("n")))


def cumulative_to_current(obs: DataFrame, reset_yearly: bool = False) -> DataFrame:
    """First difference of cumulative values, the first row kept as it is.

    The default never resets in January; ``reset_yearly`` starts each year anew."""
    w = Window.partitionBy("series", F.year("d")).orderBy("d") if reset_yearly else by_date()
    step = F.col("v") - F.lag("v").over(w)
    return obs.withColumn("v", F.when(F.row_number().over(w) == 1, F.col("v")).otherwise(step))


def gap_report(obs: DataFrame, start=None, end=None) -> DataFrame:
    """Longest run of nulls after the first valid value, earliest on ties.

    Rows must be dense over the calendar of interest.  A series without any
    valid value counts its full length."""
    if start is not None:
        obs = obs.filter(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        obs = obs.filter(F.col("d") <= F.lit(end).cast("date"))
    null = F.col("v").isNull()
    placed = obs.withColumn("_island", F.count("v").over(by_date())).withColumn("_any", F.count("v").over(whole()))
    islands = placed.groupBy("series", "_island").agg(
        F.first("_any").alias("_any"), F.count(F.lit(1)).alias("n"), F.count_if(null).alias("n_null"),
        F.min(F.when(null, F.col("d"))).alias("lo"), F.max(F.when(null, F.col("d"))).alias("hi"))
    counts = (F.col("_island") > 0) | (F.col("_any") == 0)
    run = F.when(counts & (F.col("n_null") > 0), F.struct(
        F.col("n_null").alias("len"), (-F.datediff("lo", F.lit("1970-01-01").cast("date"))).alias("early"),
        F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    best = islands.groupBy("series").agg(F.max(run).alias("r"), F.sum("n").alias("total"),
                                         F.sum("n_null").alias("missing"))
    return best.select("series", F.coalesce(F.col("r.len"), F.lit(0)).alias("longest_gap"),
                       F.col("r.lo").alias("gap_start"), F.col("r.hi").alias("gap_end"), "total", "missing",
                       (F.col("missing") * 100.0 / F.col("total")).alias("missing_pct"))


def drop_gappy(obs: DataFrame, threshold: int | None, start=None, end=None) -> DataFrame:
    """Without series whose longest gap inside the date range reaches ``threshold``.

    The rule of :func:`gap_report` as windows on one partitioning by series:
    no second read of the input and no join."""
    if not threshold or threshold <= 0:
        return obs
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("d") <= F.lit(end).cast("date"))
    valid, null = inside & F.col("v").isNotNull(), inside & F.col("v").isNull()
    placed = obs.withColumn("_i", F.count_if(valid).over(by_date())).withColumn("_any", F.count_if(valid).over(whole()))
    runs = placed.withColumn("_run", F.count_if(null).over(Window.partitionBy("series", "_i")))
    counted = F.when((F.col("_i") > 0) | (F.col("_any") == 0), F.col("_run"))
    return (runs.withColumn("_longest", F.coalesce(F.max(counted).over(whole()), F.lit(0)))
            .filter(F.col("_longest") < threshold).select(*obs.columns))


def trailing_means(obs: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Mean over the ``n`` days before each date, the date itself excluded."""
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    out = obs
    for n in days:
        w = Window.partitionBy("series").orderBy(day).rangeBetween(-n, -1)
        out = out.withColumn(f"mean_{n}", F.avg("v").over(w))
    return out


def detrend(obs: DataFrame) -> DataFrame:
    """Residual of a straight line over row position; needs three valid points.

    Positions count all rows of the series, valid or not; nulls stay null."""
    pos = obs.withColumn("_p", (F.row_number().over(by_date()) - 1).cast("double"))
    x = F.when(F.col("v").isNotNull(), F.col("_p"))
    line = F.regr_intercept("v", x).over(whole()) + F.regr_slope("v", x).over(whole()) * F.col("_p")
    return pos.withColumn("trend", F.when(F.count("v").over(whole()) >= 3, line)).withColumn(
        "v", F.col("v") - F.col("trend")).drop("_p")


def running_impact(impacts: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("model_id", "month")) -> DataFrame:
    """Nowcast path from the baseline as releases arrive, and the signed totals.

    Releases of one date are summed first, so a path has at most one row per
    day of its month however many variables report."""
    i = F.col("impact")
    days = impacts.groupBy(*keys, "ts").agg(
        F.sum(i).alias("impact"), F.sum(F.when(i > 0, i)).alias("_up"), F.sum(F.when(i < 0, i)).alias("_down"))
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    return days.join(baseline, list(keys), "left").select(
        *keys, "ts", "impact", "baseline", F.sum("impact").over(ordered).alias("cumulative"),
        (F.col("baseline") + F.sum("impact").over(ordered)).alias("running"), F.sum("impact").over(w).alias("total"),
        zero("_up").alias("total_positive"), zero("_down").alias("total_negative"))


def shift_publication(obs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Move each series' dates by its publication lag; an unlisted series stays."""
    lags = dictionary.select("name_norm", F.col("publication_lag_days").alias("_lag"))
    names = obs.select("series").distinct().withColumn("name_norm", text.normalize_text(F.col("series")))
    named = obs.join(names.join(lags, "name_norm").select("series", "_lag"), "series", "left")
    lag = F.coalesce("_lag", F.lit(0))
    checked = F.when(lag.between(0, 365), lag).otherwise(
        F.raise_error(F.format_string("publication lag of %s out of range: %s", F.col("series"), lag)))
    return (named.filter(F.col("v").isNotNull() | (lag == 0))
            .withColumn("d", F.date_add("d", checked.cast("int"))).select(*obs.columns))


def moving_average(obs: DataFrame, n: int = 7) -> DataFrame:
    """Trailing mean of ``n`` rows, null until ``n`` valid values were seen."""
    w = by_date().rowsBetween(-(n - 1), 0)
    return obs.withColumn("moving", F.when(F.count("v").over(w) == n, F.avg("v").over(w)))


def weekly_year_overlay(obs: DataFrame, current_year: int) -> DataFrame:
    """Last value per ISO week, this calendar year and the one before, weeks 1-53."""
    year = F.year("d")
    recent = obs.filter(year.isin(current_year, current_year - 1) & F.col("v").isNotNull())
    grouped = recent.groupBy("series", F.weekofyear("d").alias("week")).agg(
        F.max_by(F.when(year == current_year, F.col("v")), F.when(year == current_year, F.col("d"))).alias("current"),
        F.max_by(F.when(year == current_year - 1, F.col("v")), F.when(year == current_year - 1, F.col("d"))).alias("previous"))
    weeks = obs.select("series").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(53))))
    return weeks.join(grouped, ["series", "week"], "left")


def standardize(obs: DataFrame, method: str = "zscore") -> DataFrame:
    """Z-score (sample deviation) or min-max per series; unchanged without spread."""
    v = F.col("v")
    if method == "none":
        return obs
    if method == "zscore":
        centre, spread = F.avg(v).over(whole()), F.stddev_samp(v).over(whole())
    else:
        centre = F.min(v).over(whole())
        spread = F.max(v).over(whole()) - centre
    flat = F.coalesce(F.min(v).over(whole()) == F.max(v).over(whole()), F.lit(True))
    return obs.withColumn("v", F.when(flat, v).otherwise((v - centre) / spread))


def fit_scaler(obs: DataFrame, train_end=None, keys=("series",)) -> DataFrame:
    """Training-window mean and deviation per series; no spread gives 1."""
    train = F.col("d") <= F.lit(train_end).cast("date") if train_end is not None else F.lit(True)
    v = F.when(train, F.col("v"))
    flat = F.coalesce(F.min(v) == F.max(v), F.lit(True)) | (F.count(v) < 2)
    return obs.groupBy(*keys).agg(F.avg(v).alias("mu"), F.when(flat, 1.0).otherwise(F.stddev_samp(v)).alias("sigma"))


def apply_scaler(obs: DataFrame, scaler: DataFrame, fill: float | None = 0.0, keys=("series",)) -> DataFrame:
    """Scaled values with the training moments; missing becomes ``fill``."""
    z = (F.col("v") - F.col("mu")) / F.col("sigma")
    joined = obs.join(scaler, list(keys))
    return joined.withColumn("v", F.coalesce(z, F.lit(fill)) if fill is not None else z).drop("mu", "sigma")


def unscale(obs: DataFrame, scaler: DataFrame, keys=("series",)) -> DataFrame:
    return obs.join(scaler, list(keys)).withColumn("v", F.col("v") * F.col("sigma") + F.col("mu")).drop("mu", "sigma")


def centre(obs: DataFrame, scaler: DataFrame, keys=("series",)) -> DataFrame:
    return obs.join(scaler, list(keys)).withColumn("v", F.col("v") - F.col("mu")).drop("mu", "sigma")
