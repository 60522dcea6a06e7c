"""Filters, value rules and removals on long observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab

RULE_SCHEMA = ("rule_id int, variable string, rule_type string, months array<int>, weeks array<int>, "
               "start_date date, end_date date, condition_type string, value1 double, value2 double, "
               "replace_with double")


def one_row_per_date(obs: DataFrame, keep: str = "last", keys=("series", "d")) -> DataFrame:
    """Collapse repeated dates with map-side combine, whatever a date's volume.

    ``last`` and ``first`` follow ``src_pos``; ``mean`` averages valid values."""
    pick = {"last": lambda: F.max_by("v", "src_pos"), "first": lambda: F.min_by("v", "src_pos"),
            "mean": lambda: F.avg("v")}[keep]()
    return obs.groupBy(*keys).agg(pick.alias("v"))


def drop_missing(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def between_dates(obs: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive date range, as literals that reach the scan."""
    if start is not None:
        obs = obs.filter(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        obs = obs.filter(F.col("d") <= F.lit(end).cast("date"))
    return obs


def recent_years(obs: DataFrame, years: int) -> DataFrame:
    """Rows from ``years`` before the newest date of the whole table."""
    newest = obs.select(F.max("d")).scalar()
    return obs.filter(F.col("d") >= F.add_months(newest, -12 * years))


def month_range(obs: DataFrame, first_month: str, last_month: str) -> DataFrame:
    """Rows from the first day of one month to the last day of another."""
    return obs.filter((F.col("d") >= F.to_date(F.lit(first_month + "-01")))
                      & (F.col("d") <= F.last_day(F.to_date(F.lit(last_month + "-01")))))


def zero_rule(v: Column, method: str = "missing") -> Column:
    """Zeros to null (``missing``), to one (``adjust``), or kept (``none``)."""
    if method == "none":
        return v
    return F.when(v == 0, F.lit(None) if method == "missing" else F.lit(1.0)).otherwise(v)


def negative_rule(v: Column, method: str = "none") -> Column:
    if method == "none":
        return v
    return F.when(v < 0, F.lit(None) if method == "missing" else F.lit(1.0)).otherwise(v)


def near_zero_to_null(v: Column, threshold: float = vocab.NEAR_ZERO) -> Column:
    return F.when(F.abs(v) >= threshold, v)


def removal_log(obs: DataFrame) -> DataFrame:
    """Which series a full clean removes, and why: unnamed, repeated source, empty."""
    per_source = obs.groupBy("series", "source").agg(
        F.min("src_pos").alias("pos"), F.count("v").alias("n"))
    first = per_source.groupBy("series").agg(F.min_by("source", F.struct("pos", "source")).alias("kept"))
    reason = (F.when(F.col("series").startswith("Unnamed") | (F.trim("series") == ""), "unnamed")
              .when(F.col("source") != F.col("kept"), "duplicate").when(F.col("n") == 0, "all_null"))
    return (per_source.join(first, "series").withColumn("reason", reason)
            .filter(F.col("reason").isNotNull()).select("series", "source", "reason"))


def clean(obs: DataFrame, zeros: str = "missing") -> DataFrame:
    """Zero rule, then drop unnamed and duplicate series, empty series, empty dates."""
    ruled = obs.withColumn("v", zero_rule(F.col("v"), zeros))
    kept = ruled.join(removal_log(ruled), ["series", "source"], "left_anti")
    dates = kept.groupBy("d").agg(F.count("v").alias("n")).filter("n > 0").select("d")
    return kept.join(dates, "d", "left_semi")


def removed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Series present before and absent after."""
    return before.select("series").distinct().join(after.select("series").distinct(), "series", "left_anti")


def removal_summary(log: DataFrame) -> DataFrame:
    """Removed variables with the size of their reason: one row per name, so no
    list has to fit in one place."""
    names = log.select("reason", "series").distinct()
    return names.join(names.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "reason")


def _rule_mask(rule: Column, d: Column, v: Column) -> Column:
    kind, cond = rule["rule_type"], rule["condition_type"]
    lo, hi = rule["value1"], rule["value2"]
    condition = (F.when(cond == "eq", v == lo).when(cond == "gt", v > lo).when(cond == "lt", v < lo)
                 .when(cond == "gte", v >= lo).when(cond == "lte", v <= lo)
                 .when(cond == "between", v.between(lo, hi)).when(cond == "isnull", v.isNull()))
    mask = (F.when(kind == "months", F.array_contains(rule["months"], F.month(d)))
            .when(kind == "weeks_yearly", F.array_contains(rule["weeks"], F.weekofyear(d)))
            .when(kind == "weeks_monthly",
                  F.array_contains(rule["weeks"], (F.floor((F.day(d) - 1) / 7) + 1).cast("int")))
            .when(kind == "date_range", (F.coalesce(rule["start_date"], d) <= d)
                  & (F.coalesce(rule["end_date"], d) >= d))
            .when(kind == "condition", condition))
    return F.coalesce(mask, F.lit(False))


def replace_by_rules(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply each variable's rules in ``rule_id`` order; later rules see earlier
    results.  ``original`` keeps the first value and ``n_hits`` the rules that
    matched, so previewing is a filter and undoing a projection."""
    chains = rules.groupBy("variable").agg(
        F.array_sort(F.collect_list(F.struct(*[f.split()[0] for f in RULE_SCHEMA.split(", ")]))).alias("_rules"))
    joined = obs.join(chains.withColumnRenamed("variable", "series"), "series", "left")
    start = F.struct(F.col("v").alias("v"), F.lit(0).alias("hits"))

    def step(acc: Column, rule: Column) -> Column:
        hit = _rule_mask(rule, F.col("d"), acc["v"])
        return F.struct(F.when(hit, rule["replace_with"]).otherwise(acc["v"]).alias("v"),
                        (acc["hits"] + hit.cast("int")).alias("hits"))

    folded = F.aggregate(F.coalesce("_rules", F.array().cast(joined.schema["_rules"].dataType)), start, step)
    return (joined.withColumn("_f", folded)
            .select(*[c for c in obs.columns if c != "v"], F.col("_f.v").alias("v"),
                    F.col("v").alias("original"), F.col("_f.hits").alias("n_hits")))


def preview_rules(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows some rule would change."""
    return replace_by_rules(obs, rules).filter("n_hits > 0")


def undo_rules(replaced: DataFrame) -> DataFrame:
    return replaced.withColumn("v", F.col("original")).drop("original", "n_hits")


def rule_description(rules: DataFrame) -> DataFrame:
    """Readable text of each rule."""
    listed = lambda col, fmt: F.array_join(F.transform(F.array_sort(col), lambda x: F.format_string(fmt, x)), "、")
    months, weeks = F.col("months"), F.col("weeks")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    # Condition names in rule descriptions.
    words = {"eq": "等于", "gt": "大于", "lt": "小于", "gte": "大于等于", "lte": "小于等于",
             "between": "介于", "isnull": "为空"}
    word = reduce(lambda acc, kv: F.when(F.col("condition_type") == kv[0], kv[1]).otherwise(acc),
                  words.items(), F.lit("未知"))
    number = lambda c: F.col(c).cast("string")
    condition = (F.when(F.col("condition_type") == "between",
                        F.concat(word, F.lit(" "), number("value1"), F.lit(" 和 "), number("value2")))
                 .when(F.col("condition_type") == "isnull", word)
                 .otherwise(F.concat(word, F.lit(" "), number("value1"))))
    yearly = F.when(F.size(weeks) <= 3, listed(weeks, "第%d周")).otherwise(
        F.format_string("第%d-%d周", F.array_min(weeks), F.array_max(weeks)))
    kind = F.col("rule_type")
    return rules.select("rule_id", "variable", (
        F.when(kind == "months", F.when(empty(months), "未选择月份")
               .otherwise(F.concat(F.lit("每年"), listed(months, "%d月"))))
        .when(kind == "weeks_yearly", F.when(empty(weeks), "未选择周次")
              .otherwise(F.concat(F.lit("每年"), yearly)))
        .when(kind == "weeks_monthly", F.when(empty(weeks), "未选择周次")
              .otherwise(F.concat(F.lit("每月"), listed(weeks, "第%d周"))))
        .when(kind == "date_range", F.concat(
            F.coalesce(F.col("start_date").cast("string"), F.lit("起始")), F.lit(" 至 "),
            F.coalesce(F.col("end_date").cast("string"), F.lit("结束"))))
        .when(kind == "condition", condition).otherwise("未知规则")).alias("description"))


def rules_to_json(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.to_json(F.struct(*[c for c in rules.columns if c != "rule_id"])).alias("rule"))


def rules_from_json(stored: DataFrame) -> DataFrame:
    """Stored text back to rule rows; unknown keys are dropped."""
    body = RULE_SCHEMA.replace("rule_id int, ", "")
    return stored.select("rule_id", F.from_json("rule", body).alias("r")).select("rule_id", "r.*")


def flag_outliers(obs: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Adds ``is_outlier`` per series: z-score, quartile fences, or median deviation."""
    w = Window.partitionBy("series")
    v = F.col("v")
    if method == "zscore":
        flag = F.try_divide(F.abs(v - F.avg("v").over(w)), F.stddev_pop("v").over(w)) > threshold
        return obs.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))
    if method == "iqr":
        q1, q3 = (F.percentile("v", F.lit(p)).over(w) for p in (0.25, 0.75))
        spread = (q3 - q1) * threshold
        return obs.withColumn("is_outlier", F.coalesce((v < q1 - spread) | (v > q3 + spread), F.lit(False)))
    centred = obs.withColumn("_dev", v - F.median("v").over(w))
    mad = F.median(F.abs("_dev")).over(w)
    # A zero median deviation makes every departure from the median infinite.
    flag = F.when(mad == 0, F.col("_dev") != 0).otherwise(F.abs(F.col("_dev") * 0.6745 / mad) > threshold)
    return centred.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_dev")


def dates_with_any(obs: DataFrame, names: list[str]) -> DataFrame:
    """One row per date holding at least one of the named series, as columns."""
    wide = obs.filter(F.col("series").isin(names)).groupBy("d").pivot("series", names).agg(F.first("v"))
    return wide.filter(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def pick_indicators(dictionary: DataFrame, freqs=None, industry=None, kind=None,
                    exclude=(), exclude_industries=(), non_target: bool = False) -> DataFrame:
    """Catalogue rows by frequency, industry, type, exclusion list and target flag."""
    out = dictionary.withColumn("type", F.coalesce("type", F.lit(vocab.UNCLASSIFIED)))
    if freqs:
        out = out.filter(F.col("freq").isin(list(freqs)))
    if industry:
        out = out.filter(F.col("industry") == industry)
    if kind:
        out = out.filter(F.col("type") == kind)
    if exclude:
        out = out.filter(~F.col("name").isin(list(exclude)))
    if exclude_industries:
        out = out.filter(~F.col("industry").isin(list(exclude_industries)))
    return out.filter(~F.col("is_target")) if non_target else out


def industries_of_others(dictionary: DataFrame, target: str) -> DataFrame:
    """Industries that hold some indicator besides the target."""
    return (dictionary.groupBy("industry").agg(F.count_if(F.col("name") != target).alias("n"))
            .filter("n > 0"))


def frequency_catalogue(indicators: DataFrame) -> DataFrame:
    """Industries of each frequency, one per row, with their number; the industry
    falls back to the source name."""
    from tidemark.functions.text import industry_from_source
    named = indicators.select("freq", F.coalesce(
        F.when(F.trim("industry") != "", F.col("industry")), industry_from_source(F.col("source"))).alias("industry"))
    pairs = named.distinct()
    return pairs.join(pairs.groupBy("freq").agg(F.count(F.lit(1)).alias("n_industries")), "freq")
