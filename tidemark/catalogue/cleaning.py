"""B: filters, value rules, outliers, catalogue filters."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.functions import numeric, text
from tidemark.operators import clean


@query("one_row_per_date", "series:s d:d v:f", "SELECT series, d, last(v ORDER BY src_pos) AS v FROM @ticks GROUP BY 1, 2")
def one_row_per_date(spark, sf):
    return clean.one_row_per_date(bases.ticks(spark, sf))


@query("numeric_cleaning", "event_type:s v:f n:n", """SELECT event_type, v, count(*) AS n FROM (SELECT event_type,
    TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL GROUP BY 1, 2""")
def numeric_cleaning(spark, sf):
    ev = bases.table(spark, sf, "events").select(
        F.trim("event_type").alias("event_type"), numeric.to_number(F.regexp_extract("props", "[0-9]+", 0)).alias("v"))
    return clean.drop_missing(ev).groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("n"))


@query("date_range_filter", "series:s d:d v:f", "SELECT * FROM @daily WHERE d BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def date_range_filter(spark, sf):
    return clean.between_dates(bases.daily(spark, sf), "1997-03-01", "1998-02-28")


@query("recent_years", "series:s d:d v:f", "SELECT * FROM @daily WHERE d >= (SELECT max(d) FROM @daily) - INTERVAL 3 YEAR")
def recent_years(spark, sf):
    return clean.recent_years(bases.daily(spark, sf), 3)


@query("month_range", "series:s d:d v:f", "SELECT * FROM @monthly WHERE d BETWEEN DATE '1999-02-01' AND DATE '2000-02-29'")
def month_range(spark, sf):
    return clean.month_range(bases.monthly(spark, sf), "1999-02", "2000-02")


REMOVALS = """
    WITH t AS (SELECT CASE WHEN series = '5-LOW' THEN 'Unnamed: 5' ELSE series END AS series, source, v, d, src_pos FROM @ticks),
    p AS (SELECT series, source, min(src_pos) AS pos, count(v) AS n FROM t GROUP BY 1, 2),
    k AS (SELECT series, arg_min(source, (pos, source)) AS kept FROM p GROUP BY 1),
    log AS (SELECT p.series, p.source, CASE WHEN p.series LIKE 'Unnamed%' THEN 'unnamed' WHEN p.source <> kept THEN 'duplicate'
       WHEN n = 0 THEN 'all_null' END AS reason FROM p JOIN k USING (series))"""


def _named(spark, sf):
    return bases.ticks(spark, sf).withColumn("series", F.when(F.col("series") == "5-LOW", "Unnamed: 5").otherwise(F.col("series")))


@query("removal_log", "series:s source:s reason:s", REMOVALS + "SELECT * FROM log WHERE reason IS NOT NULL")
def removal_log(spark, sf):
    return clean.removal_log(_named(spark, sf))


@query("clean_table", "series:s source:s d:d v:f src_pos:n", REMOVALS + """,
    kept AS (SELECT t.series, t.source, t.d, nullif(t.v, 0.0) AS v, t.src_pos FROM t JOIN log USING (series, source) WHERE reason IS NULL)
    SELECT * FROM kept WHERE d IN (SELECT d FROM kept WHERE v IS NOT NULL)""")
def clean_table(spark, sf):
    return clean.clean(_named(spark, sf))


@query("removed_names", "series:s", """SELECT DISTINCT series FROM @sparse EXCEPT
    SELECT DISTINCT series FROM @sparse WHERE v > 2.4""")
def removed_names(spark, sf):
    s = bases.sparse(spark, sf)
    return clean.removed_names(s, s.filter("v > 2.4"))


@query("removal_summary", "reason:s series:s n:n", REMOVALS + """SELECT DISTINCT l.reason, series, n FROM log l
    JOIN (SELECT reason, count(DISTINCT series) AS n FROM log WHERE reason IS NOT NULL GROUP BY 1) c ON c.reason = l.reason""")
def removal_summary(spark, sf):
    return clean.removal_summary(clean.removal_log(_named(spark, sf)))


@query("zero_negative_rules", "s_suppkey:n missing:f adjusted:f near_zero:f", """
    SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE nullif(s_acctbal, 0) END AS missing,
      CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE s_acctbal END AS adjusted,
      CASE WHEN abs(s_acctbal) >= 1e-9 THEN s_acctbal END AS near_zero FROM supplier""")
def zero_negative_rules(spark, sf):
    v = F.col("s_acctbal")
    return bases.table(spark, sf, "supplier").select(
        "s_suppkey", clean.negative_rule(clean.zero_rule(v, "missing"), "missing").alias("missing"),
        clean.negative_rule(clean.zero_rule(v, "adjust"), "adjust").alias("adjusted"),
        clean.near_zero_to_null(v).alias("near_zero"))


# One set of rules per series, its bounds read from the data.
RULE_SQL = """
    WITH r AS (SELECT series, avg_v, CASE WHEN series < '3' THEN 1 ELSE 2 END AS kind FROM
        (SELECT series, round(avg(v), 3) AS avg_v FROM @daily GROUP BY 1)),
    s1 AS (SELECT d.series, d.d, d.v AS original, kind, avg_v,
        CASE WHEN kind = 1 AND month(d.d) IN (1, 2) THEN NULL WHEN kind = 2 AND weekofyear(d.d) IN (1, 52, 53) THEN 0.0 ELSE d.v END AS a,
        CASE WHEN kind = 1 THEN month(d.d) IN (1, 2) ELSE weekofyear(d.d) IN (1, 52, 53) END AS h1
      FROM @daily d JOIN r USING (series)),
    s2 AS (SELECT *, CASE WHEN kind = 1 THEN a > avg_v * 2 ELSE (day(d) - 1) // 7 + 1 = 5 END AS h2 FROM s1),
    s3 AS (SELECT *, CASE WHEN coalesce(h2, false) THEN avg_v ELSE a END AS b FROM s2),
    s4 AS (SELECT *, d BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' AS h3 FROM s3)
    SELECT series, d, CASE WHEN h3 THEN -1.0 ELSE b END AS v, original,
      CAST(h1 AS INT) + CAST(coalesce(h2, false) AS INT) + CAST(h3 AS INT) AS n_hits FROM s4"""


def _rules(spark, sf):
    level = bases.daily(spark, sf).groupBy("series").agg(F.round(F.avg("v"), 3).alias("avg_v"))
    first = F.col("series") < "3"
    null = lambda t: F.lit(None).cast(t)
    ints = lambda *xs: F.array(*map(F.lit, xs))

    def rule(i, kind, months=None, weeks=None, start=None, end=None, cond=None, value1=None, value2=None, new=None):
        cells = [(F.lit(i), "rule_id", "int"), (F.col("series"), "variable", "string"), (kind, "rule_type", "string"),
                 (months, "months", "array<int>"), (weeks, "weeks", "array<int>"), (start, "start_date", "date"),
                 (end, "end_date", "date"), (cond, "condition_type", "string"), (value1, "value1", "double"),
                 (value2, "value2", "double"), (new, "replace_with", "double")]
        return F.struct(*[(null(t) if c is None else c.cast(t)).alias(n) for c, n, t in cells])

    rules = F.array(
        rule(1, F.when(first, "months").otherwise("weeks_yearly"), months=ints(1, 2), weeks=ints(1, 52, 53),
             new=F.when(~first, 0.0)),
        rule(2, F.when(first, "condition").otherwise("weeks_monthly"), weeks=ints(5), cond=F.lit("gt"),
             value1=F.col("avg_v") * 2, new=F.col("avg_v")),
        rule(3, F.lit("date_range"), start=F.lit("1997-01-01"), end=F.lit("1997-01-31"), new=F.lit(-1.0)))
    return level.select(F.explode(rules).alias("r")).select("r.*")


@query("replace_by_rules", "series:s d:d v:f original:f n_hits:n", RULE_SQL)
def replace_by_rules(spark, sf):
    return clean.replace_by_rules(bases.daily(spark, sf), _rules(spark, sf))


@query("preview_rules", "series:s d:d original:f n_hits:n", f"SELECT * FROM ({RULE_SQL}) WHERE n_hits > 0")
def preview_rules(spark, sf):
    return clean.preview_rules(bases.daily(spark, sf), _rules(spark, sf))


@query("undo_rules", "series:s d:d v:f", "SELECT * FROM @daily")
def undo_rules(spark, sf):
    return clean.undo_rules(clean.replace_by_rules(bases.daily(spark, sf), _rules(spark, sf)))


@query("rules_json_round_trip", "rule_id:n variable:s rule_type:s months:s start_date:d value1:f", """
    SELECT id AS rule_id, series AS variable, CASE WHEN id = 3 THEN 'date_range' WHEN series < '3' THEN CASE id WHEN 1 THEN 'months' ELSE 'condition' END
      ELSE CASE id WHEN 1 THEN 'weeks_yearly' ELSE 'weeks_monthly' END END AS rule_type,
      CASE WHEN id = 1 THEN '1,2' END AS months, CASE WHEN id = 3 THEN DATE '1997-01-01' END AS start_date,
      CASE WHEN id = 2 THEN avg_v * 2 END AS value1
    FROM (SELECT series, round(avg(v), 3) AS avg_v FROM @daily GROUP BY 1), (VALUES (1), (2), (3)) AS i(id)""")
def rules_json_round_trip(spark, sf):
    return clean.rules_from_json(clean.rules_to_json(_rules(spark, sf))).withColumn("months", F.array_join("months", ","))


@query("rule_descriptions", "variable:s rule_id:n description:s", """
    SELECT series AS variable, id AS rule_id, CASE WHEN id = 3 THEN '1997-01-01 至 1997-01-31'
      WHEN series < '3' THEN CASE id WHEN 1 THEN '每年1月、2月' ELSE '大于 ' || CAST(avg_v * 2 AS VARCHAR) END
      ELSE CASE id WHEN 1 THEN '每年第1周、第52周、第53周' ELSE '每月第5周' END END AS description
    FROM (SELECT series, round(avg(v), 3) AS avg_v FROM @daily GROUP BY 1), (VALUES (1), (2), (3)) AS i(id)""")
def rule_descriptions(spark, sf):
    return clean.rule_description(_rules(spark, sf))


@query("outliers_zscore", "series:s d:d is_outlier:b", """SELECT series, d, coalesce(abs(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) > 2.0, false) AS is_outlier
    FROM @sparse WINDOW w AS (PARTITION BY series)""")
def outliers_zscore(spark, sf):
    return clean.flag_outliers(bases.sparse(spark, sf), "zscore", 2.0)


@query("outliers_iqr", "series:s d:d is_outlier:b", """
    WITH q AS (SELECT series, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM @sparse GROUP BY 1)
    SELECT series, d, coalesce(v < q1 - (q3 - q1) * 0.5 OR v > q3 + (q3 - q1) * 0.5, false) AS is_outlier FROM @sparse JOIN q USING (series)""")
def outliers_iqr(spark, sf):
    return clean.flag_outliers(bases.sparse(spark, sf), "iqr", 0.5)


@query("outliers_modified", "series:s d:d is_outlier:b", """
    WITH m AS (SELECT series, median(v) AS med FROM @sparse GROUP BY 1),
    a AS (SELECT series, median(abs(v - med)) AS mad FROM @sparse JOIN m USING (series) GROUP BY 1)
    SELECT series, d, coalesce(CASE WHEN mad = 0 THEN v <> med ELSE abs((v - med) * 0.6745 / mad) > 1.5 END, false) AS is_outlier
    FROM @sparse JOIN m USING (series) JOIN a USING (series)""")
def outliers_modified(spark, sf):
    return clean.flag_outliers(bases.sparse(spark, sf), "modified", 1.5)


@query("dates_with_any", "d:d a:f b:f", """SELECT d, max(CASE WHEN series = 'S1' THEN v END) AS a, max(CASE WHEN series = 'S2' THEN v END) AS b
    FROM @sparse WHERE series IN ('S1', 'S2') GROUP BY 1 HAVING count(v) > 0""")
def dates_with_any(spark, sf):
    return clean.dates_with_any(bases.sparse(spark, sf), ["S1", "S2"]).select("d", F.col("S1").alias("a"), F.col("S2").alias("b"))


@query("pick_indicators", "name:s freq:s industry:s type:s", """SELECT * FROM @dictionary WHERE freq IN ('W', 'M')
    AND industry <> 'Brand#1' AND name <> 'red bolt' AND NOT is_target""")
def pick_indicators(spark, sf):
    return clean.pick_indicators(bases.dictionary(spark, sf), freqs=("W", "M"), exclude=("red bolt",),
                                 exclude_industries=("Brand#1",), non_target=True)


@query("industries_of_others", "industry:s n:n", """SELECT industry, count(*) AS n FROM @dictionary WHERE name <> 'red bolt' GROUP BY 1""")
def industries_of_others(spark, sf):
    return clean.industries_of_others(bases.dictionary(spark, sf), "red bolt")


@query("search_rows", "p_partkey:n p_name:s", """SELECT p_partkey, p_name FROM part
    WHERE p_name ILIKE '%bolt%' OR p_brand ILIKE '%bolt%' OR p_type ILIKE '%bolt%' OR CAST(p_partkey AS VARCHAR) ILIKE '%bolt%'""")
def search_rows(spark, sf):
    cols = ("p_name", "p_brand", "p_type", "p_partkey")
    return bases.table(spark, sf, "part").filter(text.contains_any("Bolt", *map(F.col, cols)))


@query("frequency_catalogue", "freq:s industry:s n_industries:n", """
    WITH n AS (SELECT DISTINCT freq_text AS freq, CASE WHEN lag_text < '3' THEN regexp_extract(name, '^[^ ]+') ELSE industry END AS industry FROM @dictionary_raw)
    SELECT freq, industry, count(*) OVER (PARTITION BY freq) AS n_industries FROM n""")
def frequency_catalogue(spark, sf):
    raw = bases.dictionary_raw(spark, sf).select(
        F.col("freq_text").alias("freq"), F.when(F.col("lag_text") >= "3", F.col("industry")).alias("industry"),
        F.concat(F.lit("file.csv|"), F.replace("name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("freq_text")).alias("source"))
    return clean.frequency_catalogue(raw)
