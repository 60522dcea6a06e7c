"""H: names, dates, formats."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.functions import calendar as cal
from tidemark.functions import numeric, text
from tidemark.functions.text import TIGHT_PUNCTUATION

HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"


def q(s):
    """SQL string literal; the at sign is spelled out, it marks base tables here."""
    return "('" + s.replace("'", "''").replace("@", "' || chr(64) || '") + "')"


def _fold(c):
    return f"translate({c}, {q(FULL)}, {q(HALF)})"


def _ascii_lower(c):
    return f"CASE WHEN regexp_matches({c}, '[\\x00-\\x7F]') THEN lower({c}) ELSE {c} END"


def _strip(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _tight(c):
    for mark in TIGHT_PUNCTUATION:
        c = f"replace(replace({c}, {q(' ' + mark)}, {q(mark)}), {q(mark + ' ')}, {q(mark)})"
    return c


# Names as the source would spell them: full-width marks, blanks, mixed case.
NAMES_SQL = """SELECT DISTINCT '  ' || upper(p_name) || '：' || p_type || '（' || p_brand || '） ，  ' || lower(p_type) || ' ' AS name FROM part"""


def _names(spark, sf):
    p = bases.table(spark, sf, "part")
    return p.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit("："), "p_type", F.lit("（"), "p_brand", F.lit("） ，  "),
                             F.lower("p_type"), F.lit(" ")).alias("name")).distinct()




@query("normalize_text", "name:s norm:s cased:s", f"""WITH n AS ({NAMES_SQL}), a AS (SELECT name, trim(regexp_replace(
    {_tight(_strip(_fold('name')))}, '\\s+', ' ', 'g')) AS cased FROM n)
    SELECT name, cased, {_ascii_lower('cased')} AS norm FROM a""")
def normalize_text(spark, sf):
    n = F.col("name")
    return _names(spark, sf).select(n, text.normalize_text(n).alias("norm"), text.normalize_text(n, to_lower=False).alias("cased"))


@query("normalize_documents", "doc_id:n norm:s variable:s", f"""
    WITH a AS (SELECT doc_id, text, trim(regexp_replace({_tight(_strip(_fold('text')))}, '\\s+', ' ', 'g')) AS c,
      {_strip(_fold('text'))} AS v FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' ELSE {_ascii_lower('c')} END AS norm,
      CASE WHEN text IS NULL OR text = '' THEN '' ELSE replace({_ascii_lower('v')}, ' ', '') END AS variable FROM a""")
def normalize_documents(spark, sf):
    t = F.col("text")
    return bases.table(spark, sf, "documents").select(
        "doc_id", text.normalize_text(t).alias("norm"), text.normalize_variable(t, drop_blanks=True).alias("variable"))


@query("normalize_text_exact", "name:s norm:s", f"""WITH n AS ({NAMES_SQL}), a AS (SELECT name, trim(regexp_replace(
    {_tight(_strip(_fold('name')))}, '\\s+', ' ', 'g')) AS cased FROM n) SELECT name, {_ascii_lower('cased')} AS norm FROM a""")
def normalize_text_exact(spark, sf):
    return _names(spark, sf).select("name", text.normalize_text(F.col("name"), exact=True).alias("norm"))


@query("normalize_heading", "name:s heading:s", f"""SELECT name, trim(regexp_replace(trim(regexp_replace(
    translate(name, '（）：　', '(): '), ':([^\\s])', ': \\1', 'g')), '\\s+', ' ', 'g')) AS heading FROM ({NAMES_SQL})""")
def normalize_heading(spark, sf):
    return _names(spark, sf).select("name", text.normalize_heading(F.col("name")).alias("heading"))


SHEETS = """SELECT DISTINCT p_type || '_' || CASE WHEN p_size < 10 THEN '日度' WHEN p_size < 20 THEN '周度' WHEN p_size < 30 THEN '旬度' ELSE '月度' END
    || CASE WHEN p_size % 2 = 0 THEN '_Wind_' || p_brand ELSE '' END AS sheet FROM part"""


def _sheets(spark, sf):
    size = F.col("p_size")
    freq = F.when(size < 10, "日度").when(size < 20, "周度").when(size < 30, "旬度").otherwise("月度")
    return bases.table(spark, sf, "part").select(F.concat(
        "p_type", F.lit("_"), freq, F.when(size % 2 == 0, F.concat(F.lit("_Wind_"), "p_brand")).otherwise("")).alias("sheet")).distinct()


@query("sheet_info", "sheet:s industry:s feed:s source:s freq:s name:s", f"""
    SELECT sheet, split_part(sheet, '_', 1) AS industry, CASE WHEN lower(sheet) = 'promo_月度' THEN 'monthly_target' ELSE CASE split_part(sheet, '_', 2) WHEN '日度' THEN 'daily' WHEN '周度' THEN 'weekly'
      WHEN '旬度' THEN 'dekad' ELSE 'monthly_predictor' END END AS feed, CASE WHEN contains(sheet, 'Wind') THEN 'Wind_' || split_part(sheet, '_', 4) END AS source,
      CASE split_part(sheet, '_', 2) WHEN '日度' THEN 'daily' WHEN '周度' THEN 'weekly' WHEN '旬度' THEN 'ten_day' ELSE 'monthly' END AS freq,
      split_part(sheet, '_', 1) AS name FROM ({SHEETS})""")
def sheet_info(spark, sf):
    s = F.col("sheet")
    return _sheets(spark, sf).select(s, text.sheet_info(s, "PROMO_月度").alias("i"), text.sheet_frequency(s).alias("freq"),
                                     text.industry_from_source(F.concat(F.lit("file|"), s)).alias("name")).select("*", "i.*")


@query("display_names", "name:s shown:s short:s", """
    SELECT name, CASE WHEN name LIKE '出口依赖_%' THEN replace(name, '出口依赖_', '') || '行业' WHEN name LIKE '上中下游_%' THEN replace(name, '上中下游_', '') ELSE name END AS shown,
      CASE WHEN ends_with(name, ':当月同比') THEN replace(regexp_replace(name, '^规模以上工业增加值:', ''), ':当月同比', '') ELSE name END AS short
    FROM (SELECT DISTINCT CASE WHEN p_size < 15 THEN '出口依赖_' || p_type WHEN p_size < 30 THEN '上中下游_' || p_brand ELSE '规模以上工业增加值:' || p_name || ':当月同比' END AS name FROM part)""")
def display_names(spark, sf):
    size = F.col("p_size")
    name = F.when(size < 15, F.concat(F.lit("出口依赖_"), "p_type")).when(size < 30, F.concat(F.lit("上中下游_"), "p_brand")).otherwise(
        F.concat(F.lit("规模以上工业增加值:"), "p_name", F.lit(":当月同比")))
    n = F.col("name")
    return bases.table(spark, sf, "part").select(name.alias("name")).distinct().select(
        n, text.display_name(n).alias("shown"), text.short_indicator(n).alias("short"))


@query("formatted_numbers", "s_suppkey:n sign:s shown:s bins:n ratio:f", """
    SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'positive' WHEN s_acctbal < 0 THEN 'negative' END AS sign,
      CASE WHEN s_acctbal IS NULL OR isnan(s_acctbal) THEN '-' ELSE format('{:.1f}', round(s_acctbal + 0.003, 1)) END AS shown, CAST(greatest(2, ceil(least(sqrt(s_suppkey + 1), 10 * log10(s_suppkey + 1)))) AS BIGINT) AS bins,
      CASE WHEN abs(s_acctbal) < 1e-15 THEN 0 ELSE 1000 / s_acctbal END AS ratio FROM supplier""")
def formatted_numbers(spark, sf):
    v, n = F.col("s_acctbal"), F.col("s_suppkey") + 1
    return bases.table(spark, sf, "supplier").select(
        "s_suppkey", text.sign_class(v).alias("sign"), text.fixed_decimals(v + 0.003, 1).alias("shown"),
        numeric.histogram_bins(n).alias("bins"), numeric.guarded_divide(F.lit(1000.0), v).alias("ratio"))


@query("month_shift", "d:d previous_end:d month_start:d month_end:d", """SELECT DISTINCT d, CAST(date_trunc('month', d) - INTERVAL 1 DAY AS DATE) AS previous_end,
    CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end FROM @daily""")
def month_shift(spark, sf):
    d = F.col("d")
    lo, hi = cal.month_bounds(d)
    return bases.daily(spark, sf).select(d).distinct().select(
        d, cal.previous_month_end(d).alias("previous_end"), lo.alias("month_start"), hi.alias("month_end"))


@query("recommended_ops", "name:s nature:s ops:s", """SELECT name, nature, CASE WHEN nature IN ('流量', '存量') THEN 'log,diff_yoy' ELSE 'none,none' END AS ops FROM @dictionary""")
def recommended_ops(spark, sf):
    return bases.dictionary(spark, sf).select("name", "nature", F.array_join(numeric.recommended_ops(F.col("nature")), ",").alias("ops"))


@query("period_bounds", "series:s freq:s obs_start:d validation_start:d train_end:d problem:s", """
    WITH b AS (SELECT series, CASE WHEN series < '2' THEN 'D' WHEN series < '3' THEN 'W' WHEN series < '4' THEN '10D' ELSE 'M' END AS freq, max(d) AS obs_start, min(d) AS lo FROM @daily GROUP BY 1),
    v AS (SELECT *, CAST(CASE freq WHEN 'D' THEN obs_start - INTERVAL 1 DAY WHEN 'W' THEN obs_start - INTERVAL 7 DAY WHEN '10D' THEN obs_start - INTERVAL 10 DAY ELSE obs_start - INTERVAL 1 MONTH END AS DATE) AS validation_start FROM b)
    SELECT series, freq, obs_start, validation_start, validation_start - 1 AS train_end,
      CASE WHEN CASE WHEN series < '3' THEN lo ELSE obs_start END >= validation_start THEN 'training_start_not_before_limit' END AS problem FROM v""")
def period_bounds(spark, sf):
    s = F.col("series")
    b = bases.daily(spark, sf).groupBy("series").agg(F.max("d").alias("obs_start"), F.min("d").alias("lo")).withColumn(
        "freq", F.when(s < "2", "D").when(s < "3", "W").when(s < "4", "10D").otherwise("M"))
    o, f = F.col("obs_start"), F.col("freq")
    start = cal.auto_validation_start(o, f)
    return b.select(s, f, o, start.alias("validation_start"), cal.train_end(F.lit("deep_learning"), start, o, f).alias("train_end"),
                    cal.date_range_error(F.lit("classical"), F.when(s < "3", F.col("lo")).otherwise(o), start, o, f).alias("problem"))
