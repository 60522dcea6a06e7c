"""Summaries, statistics, profiles, orderings."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.catalogue.alignment import FRI
from tidemark.operators import align, rank, summary

CUR = "t AS (SELECT *, max(d) OVER (PARTITION BY series) AS cur FROM ({src}) WHERE v IS NOT NULL)"


def _at(rule):
    return f"arg_max(v, d) FILTER ({rule})"


def _summary_sql(src, refs, growth):
    cols = ", ".join(f"{e} AS {n}" for n, e in refs.items())
    return (f"WITH {CUR.format(src=src)}, a AS (SELECT series, max(cur) AS latest_date, arg_max(v, d) AS latest, {cols} "
            f"FROM t GROUP BY 1) SELECT *, {growth} FROM a")


ABS = "(latest - previous) / nullif(abs(previous), 0) AS growth"
BACK = lambda unit, n: f"date_trunc('{unit}', d) = date_trunc('{unit}', cur) - INTERVAL {n} MONTH"
MEAN = lambda n: f"avg(v) FILTER (d >= cur - {n} AND d < cur)"


@query("summary_weekly", "series:s latest_date:d latest:f previous:f growth:f", _summary_sql(
    f"SELECT series, {FRI.format(d='d')} AS d, avg(v) AS v FROM @daily GROUP BY series, {FRI.format(d='d')}",
    {"previous": _at("d = cur - 7")}, ABS))
def summary_weekly(spark, sf):
    weekly = align.daily_to_weekly(bases.daily(spark, sf))
    return rank.by_growth(summary.summarize(weekly, "W"), "growth")


@query("summary_daily", "series:s latest_date:d latest:f previous:f week_mean:f month_mean:f growth:f", _summary_sql(
    "SELECT * FROM @sparse", {"previous": _at("d = cur - 1"), "week_mean": MEAN(7), "month_mean": MEAN(30)}, ABS))
def summary_daily(spark, sf):
    return summary.summarize(bases.sparse(spark, sf), "D")


DK = "((year({x}) * 12 + month({x})) * 3 + least((day({x}) - 1) // 10, 2))"


@query("summary_dekad", "series:s latest_date:d latest:f previous:f growth:f", _summary_sql(
    "SELECT * FROM @sparse", {"previous": _at(f"{DK.format(x='d')} = {DK.format(x='cur')} - 1")}, ABS))
def summary_dekad(spark, sf):
    return summary.summarize(bases.sparse(spark, sf), "K")


def _ratio(new, ref):
    return f"(latest - {ref}) / nullif({ref}, 0) AS {new}"


@query("summary_monthly", "series:s latest_date:d latest:f previous:f year_ago:f growth:f growth_year:f", _summary_sql(
    "SELECT * FROM @monthly", {"previous": _at(BACK("month", 1)), "year_ago": _at(BACK("month", 12))},
    _ratio("growth", "previous") + ", " + _ratio("growth_year", "year_ago")))
def summary_monthly(spark, sf):
    return summary.summarize(bases.monthly(spark, sf), "M")


@query("summary_quarterly", "series:s latest_date:d latest:f previous:f year_ago:f growth:f growth_year:f", _summary_sql(
    "SELECT * FROM @sparse", {"previous": _at(BACK("quarter", 3)), "year_ago": _at(BACK("quarter", 12))},
    _ratio("growth", "previous") + ", " + _ratio("growth_year", "year_ago")))
def summary_quarterly(spark, sf):
    return summary.summarize(bases.sparse(spark, sf), "Q")


@query("summary_yearly", "series:s latest_date:d latest:f year_ago:f two_years_ago:f three_years_ago:f growth_year:f", _summary_sql(
    "SELECT * FROM @sparse", {n: _at(f"year(d) <= year(cur) - {k}") for k, n in ((1, "year_ago"), (2, "two_years_ago"), (3, "three_years_ago"))},
    "(latest - year_ago) / nullif(abs(year_ago), 0) AS growth_year"))
def summary_yearly(spark, sf):
    return summary.summarize(bases.sparse(spark, sf), "Y")


PARTS = f"""SELECT p_name AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 791900000e0 AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def _parts(spark, sf):
    return bases.table(spark, sf, "lineitem").join(
        bases.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_name").alias("series"), F.trunc("l_shipdate", "MM").alias("d")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 791900000.0).alias("v"))


@query("summary_with_units", "series:s unit:s type:s latest:f previous:f year_ago:f growth:f growth_year:f",
       "WITH s AS (" + _summary_sql(PARTS, {"previous": _at(BACK("month", 1)), "year_ago": _at(BACK("month", 12))}, "1 AS one") + """)
    SELECT s.series, unit, type, latest, previous, year_ago,
      CASE WHEN unit = '%' THEN latest - previous ELSE (latest - previous) / nullif(previous, 0) END AS growth,
      CASE WHEN unit = '%' THEN latest - year_ago ELSE (latest - year_ago) / nullif(year_ago, 0) END AS growth_year
    FROM s LEFT JOIN @dictionary dd ON dd.name = s.series""")
def summary_with_units(spark, sf):
    return summary.summarize(_parts(spark, sf), "M", bases.dictionary(spark, sf))


@query("breadth", "total:n rising:n falling:n above_week:n above_month:n rising_pct:f sentence:s",
       "WITH s AS (" + _summary_sql("SELECT * FROM @daily", {"previous": _at("d = cur - 1"), "week_mean": MEAN(7), "month_mean": MEAN(30)}, ABS) + """),
    b AS (SELECT count(*) AS total, count(*) FILTER (growth > 0) AS rising, count(*) FILTER (growth < 0) AS falling,
      count(*) FILTER (latest > week_mean) AS above_week, count(*) FILTER (latest > month_mean) AS above_month FROM s)
    SELECT *, rising * 100.0 / total AS rising_pct,
      format('共{}个指标，{}个上涨（占比{:.1f}%），{}个下跌（占比{:.1f}%）；{}个高于上周均值（占比{:.1f}%），{}个高于上月均值（占比{:.1f}%）。',
        total, rising, rising * 100e0 / total, falling, falling * 100e0 / total, above_week, above_week * 100e0 / total, above_month, above_month * 100e0 / total) AS sentence FROM b""")
def breadth(spark, sf):
    return summary.breadth(summary.summarize(bases.daily(spark, sf), "D"))


@query("catalogue_counts", "dimension:s label:s n:n", """
    SELECT 'industry' AS dimension, industry AS label, count(DISTINCT name) AS n FROM @dictionary_raw GROUP BY 2
    UNION ALL SELECT 'type', type, count(DISTINCT name) FROM @dictionary_raw GROUP BY 2
    UNION ALL SELECT 'freq', freq_text, count(DISTINCT name) FROM @dictionary_raw GROUP BY 2""")
def catalogue_counts(spark, sf):
    return summary.catalogue_counts(bases.dictionary_raw(spark, sf).withColumnRenamed("freq_text", "freq"))


@query("counts_with_total", "label:s n:n is_total:n", """SELECT industry AS label, count(*) AS n, 0 AS is_total FROM @dictionary GROUP BY 1
    UNION ALL SELECT '合计', count(*), 1 FROM @dictionary""")
def counts_with_total(spark, sf):
    return summary.counts_with_total(bases.dictionary(spark, sf), "industry")


def _expected(freq):
    lo, hi = "min(d)", "max(d)"
    return {"D": f"date_diff('day', {lo}, {hi}) + 1", "W": f"date_diff('day', {lo}, {hi}) // 7 + 1",
            "K": f"{DK.format(x=hi)} - {DK.format(x=lo)} + 1", "M": f"date_diff('month', {lo}, {hi}) + 1",
            "Q": f"date_diff('quarter', {lo}, {hi}) + 1", "Y": f"date_diff('year', {lo}, {hi}) + 1"}[freq]


FREQ_OF = "CASE CAST(substr(series, 2) AS INTEGER) % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'W' WHEN 2 THEN 'K' WHEN 3 THEN 'M' WHEN 4 THEN 'Q' ELSE 'Y' END"
CASES = " ".join(f"WHEN '{f}' THEN {_expected(f)}" for f in "DWKMQY")


def _with_freq(spark, sf):
    k = F.expr("substr(series, 2)").cast("int") % 6
    freq = F.element_at(F.array(*map(F.lit, "DWKMQY")), k + 1)
    return bases.sparse(spark, sf).withColumn("freq", freq)


@query("coverage", "series:s freq:s first_date:d last_date:d n_valid:n expected:n missing_pct:f", f"""
    WITH t AS (SELECT *, {FREQ_OF} AS freq FROM @sparse WHERE v IS NOT NULL),
    a AS (SELECT series, freq, min(d) AS first_date, max(d) AS last_date, count(*) AS n_valid, CASE freq {CASES} END AS expected FROM t GROUP BY 1, 2)
    SELECT *, (expected - n_valid) * 100.0 / expected AS missing_pct FROM a""")
def coverage(spark, sf):
    return summary.coverage(_with_freq(spark, sf))


@query("raw_quality", "series:s freq:s first_date:d last_date:d n_valid:n expected:n missing_pct:f", f"""
    WITH t AS (SELECT *, {FREQ_OF} AS freq FROM @sparse),
    a AS (SELECT series, freq, min(d) FILTER (v <> 0) AS first_date, max(d) FILTER (v <> 0) AS last_date, count(*) FILTER (v <> 0) AS n_valid FROM t GROUP BY 1, 2),
    b AS (SELECT *, greatest(ceil((date_diff('day', first_date, last_date) + 1) / (CASE freq WHEN 'D' THEN 1 WHEN 'W' THEN 7 WHEN 'K' THEN 10 WHEN 'M' THEN 30 WHEN 'Q' THEN 90 ELSE 365 END)), 1) AS expected FROM a)
    SELECT *, CASE WHEN n_valid = 0 THEN 100.0 ELSE greatest(expected - n_valid, 0) * 100.0 / expected END AS missing_pct FROM b""")
def raw_quality(spark, sf):
    return summary.raw_quality(_with_freq(spark, sf))


@query("panel_quality", "series:s n_rows:n n_valid:n missing_pct:f negative_pct:f first_date:d last_date:d", """
    WITH t AS (SELECT series, d, v - lag(v) OVER (PARTITION BY series ORDER BY d) AS v FROM @panel)
    SELECT series, count(*) AS n_rows, count(*) FILTER (v <> 0) AS n_valid, (count(*) - count(*) FILTER (v <> 0)) * 100.0 / count(*) AS missing_pct,
      coalesce(count(*) FILTER (v < 0) * 100.0 / nullif(count(*) FILTER (v <> 0), 0), 0) AS negative_pct,
      min(d) FILTER (v <> 0) AS first_date, max(d) FILTER (v <> 0) AS last_date FROM t GROUP BY 1""")
def panel_quality(spark, sf):
    from tidemark.operators.window import diff_lag
    return summary.panel_quality(diff_lag(bases.panel(spark, sf)))


PERIODS = {"W": ("weekofyear(d)", 52, "nullif(v, 0)"), "M": ("month(d)", 12, "nullif(v, 0)"),
           "K": ("(month(d) - 1) * 3 + least((day(d) - 1) // 10, 2) + 1", 36, "nullif(v, 0)"),
           "Q": ("quarter(d)", 4, "nullif(v, 0)"), "D": ("dayofyear(d)", 366, "v")}


def _profile_query(freq):
    period, size, value = PERIODS[freq]
    bands = ("low", "high", "mean")
    fill = ", ".join(f"coalesce(last_value({b} IGNORE NULLS) OVER f, last_value({b} IGNORE NULLS) OVER r) AS {b}" for b in bands)
    final = (f"SELECT series, period, {fill}, current, previous FROM s WINDOW f AS (PARTITION BY series ORDER BY period), "
             f"r AS (PARTITION BY series ORDER BY period DESC)" if freq == "D" else "SELECT * FROM s")

    @query(f"seasonal_profile_{freq.lower()}", "series:s period:n low:f high:f mean:f current:f previous:f", f"""
        WITH t AS (SELECT series, d, {value} AS v, {period} AS period FROM @sparse),
        a AS (SELECT series, period, min(v) AS low, max(v) AS high, avg(v) AS mean, arg_max(v, d) FILTER (year(d) = 2000 AND v IS NOT NULL) AS current,
          arg_max(v, d) FILTER (year(d) = 1999 AND v IS NOT NULL) AS previous FROM t GROUP BY 1, 2),
        s AS (SELECT x.series, p.period, low, high, mean, current, previous FROM (SELECT DISTINCT series FROM @sparse) x
          CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS period) p LEFT JOIN a ON a.series = x.series AND a.period = p.period)
        {final}""")
    def run(spark, sf):
        return summary.seasonal_profile(bases.sparse(spark, sf).filter(F.col("v").isNotNull()), freq, 2000)


for _f in PERIODS:
    _profile_query(_f)


@query("groups_by_size", "name:s industry:s type:s n_industry:n n_type:n", """
    SELECT name, industry, type, count(*) OVER (PARTITION BY industry) AS n_industry, count(*) OVER (PARTITION BY industry, type) AS n_type FROM @dictionary""")
def groups_by_size(spark, sf):
    return rank.groups_by_size(bases.dictionary(spark, sf))


@query("numeric_text_page", "l_orderkey:n l_linenumber:n pct:s", """
    SELECT l_orderkey, l_linenumber, pct FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '%' AS pct, l_tax FROM lineitem
    WHERE l_linestatus = 'O') ORDER BY CAST(replace(pct, '%', '') AS DOUBLE) DESC, l_orderkey, l_linenumber, pct LIMIT 50 OFFSET 50""")
def numeric_text_page(spark, sf):
    rows = bases.table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(
        "l_orderkey", "l_linenumber", F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%")).alias("pct"))
    return rank.page(rank.numeric_text_order(rows, "pct", ascending=False), 2, 50)
