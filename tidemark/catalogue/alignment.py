"""C and D1-D8: spines, merges, as-of joins, borrowing, resampling."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.registry import query
from tidemark.functions import calendar as cal
from tidemark.operators import align, clean

FRI = "CAST({d} + CAST((5 - isodow({d}) + 7) % 7 AS INTEGER) AS DATE)"
# Every window reaches from the first to the last date of both date columns.
RANGE = """(SELECT least((SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem), (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)) AS lo,
    greatest((SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS hi)"""
SPINE = f"""SELECT CAST(unnest(generate_series(CAST(lo + CAST((5 - isodow(lo) + 7) % 7 AS INTEGER) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS d
    FROM {RANGE}"""


def bounds(spark, sf):
    """First and last date of the data, as ISO text."""
    ends = lambda name, c: bases.table(spark, sf, name).agg(F.min(c).cast("date").alias("lo"), F.max(c).cast("date").alias("hi"))
    lo, hi = ends("lineitem", "l_shipdate").unionByName(ends("orders", "o_orderdate")).agg(F.min("lo"), F.max("hi")).first()
    return lo.isoformat(), hi.isoformat()


NEAREST = "CAST({d} + CAST(5 - isodow({d}) AS INTEGER) AS DATE)"


def clamp_sql(d, unit, friday=NEAREST):
    f = friday.format(d=d)
    first = f"CAST(date_trunc('{unit}', {d}) AS DATE)"
    last = f"CAST(date_trunc('{unit}', {d}) + INTERVAL 1 {unit} - INTERVAL 1 DAY AS DATE)"
    return (f"CASE WHEN date_trunc('{unit}', {f}) = date_trunc('{unit}', {d}) THEN {f} "
            f"WHEN {f} > {d} THEN CAST({last} - CAST((isodow({last}) + 2) % 7 AS INTEGER) AS DATE) "
            f"ELSE {FRI.format(d=first)} END")


DEKAD_FRI = "CAST({d} + CAST(CASE WHEN isodow({d}) = 1 THEN -3 ELSE 5 - isodow({d}) END AS INTEGER) AS DATE)"


@query("friday_mapping", "d:d week_end:d nearest:d monthly:d quarterly:d yearly:d dekad:d lagged:d is_dekad:b", f"""
    SELECT d, {FRI.format(d='d')} AS week_end, {NEAREST.format(d='d')} AS nearest, {clamp_sql('d', 'month')} AS monthly,
      {clamp_sql('d', 'quarter')} AS quarterly, {clamp_sql('d', 'year')} AS yearly, {clamp_sql('d', 'month', DEKAD_FRI)} AS dekad,
      {clamp_sql('p', 'month')} AS lagged, day(d) IN (10, 20) OR d = last_day(d) AS is_dekad
    FROM (SELECT DISTINCT d, CAST(d + 15 AS DATE) AS p FROM @daily)""")
def friday_mapping(spark, sf):
    d = F.col("d")
    return bases.daily(spark, sf).select("d").distinct().select(
        d, cal.week_ending(d).alias("week_end"), cal.period_friday(d, None).alias("nearest"),
        *[cal.period_friday(d, p).alias(n) for p, n in (("month", "monthly"), ("quarter", "quarterly"), ("year", "yearly"))],
        cal.dekad_friday(d).alias("dekad"), cal.friday_with_lag(d, F.lit(15), "month").alias("lagged"),
        cal.is_dekad_date(d).alias("is_dekad"))


@query("friday_spine", "series:s d:d", f"SELECT series, d FROM (SELECT DISTINCT series FROM @sparse), ({SPINE})")
def friday_spine(spark, sf):
    return align.friday_spine(bases.sparse(spark, sf).select("series").distinct(), *bounds(spark, sf))


@query("merge_panel", "series:s d:d v:f", f"""
    WITH a AS (SELECT series, d, v FROM @panel WHERE series <> 'NF'), b AS (SELECT series, d, v * 2 AS v FROM @panel),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE series NOT IN (SELECT series FROM a))
    SELECT s.series, p.d, u.v FROM (SELECT DISTINCT series FROM u) s CROSS JOIN ({SPINE}) p LEFT JOIN u ON u.series = s.series AND u.d = p.d""")
def merge_panel(spark, sf):
    p = bases.panel(spark, sf)
    return align.merge_panel([p.filter("series <> 'NF'"), p.withColumn("v", F.col("v") * 2)], *bounds(spark, sf))


PANEL = [f + s for f in "ANR" for s in "FO"]


@query("wide_panel", "d:d " + " ".join(f"{n}:f" for n in PANEL),
       "SELECT d, " + ", ".join(f"max(CASE WHEN series = '{n}' THEN v END) AS \"{n}\"" for n in PANEL) + " FROM @panel GROUP BY 1")
def wide_panel(spark, sf):
    return align.to_wide(bases.panel(spark, sf), PANEL)


GRID = """WITH src AS (SELECT series, d, v FROM @monthly WHERE NOT (series = '1-URGENT' AND month(d) IN (2, 3))),
    g AS (SELECT s.series, c.d, src.v FROM (SELECT DISTINCT series FROM src) s CROSS JOIN (SELECT DISTINCT d FROM src) c
      LEFT JOIN src ON src.series = s.series AND src.d = c.d)"""


def _holed(spark, sf):
    return bases.monthly(spark, sf).filter(~((F.col("series") == "1-URGENT") & F.month("d").isin(2, 3)))


@query("align_inner", "series:s d:d v:f", GRID + """SELECT series, d, v FROM src WHERE d IN
    (SELECT d FROM src GROUP BY d HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM src))""")
def align_inner(spark, sf):
    return align.align_series(_holed(spark, sf), "inner")


@query("align_left", "series:s d:d v:f", GRID + "SELECT * FROM g WHERE d IN (SELECT d FROM src WHERE series = '1-URGENT')")
def align_left(spark, sf):
    return align.align_series(_holed(spark, sf), "left", first="1-URGENT")


@query("align_outer_ffill", "series:s d:d v:f", GRID + "SELECT series, d, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY d) AS v FROM g")
def align_outer_ffill(spark, sf):
    return align.align_series(_holed(spark, sf), "outer", "ffill")


@query("align_outer_bfill", "series:s d:d v:f", GRID + "SELECT series, d, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY d DESC) AS v FROM g")
def align_outer_bfill(spark, sf):
    return align.align_series(_holed(spark, sf), "outer", "bfill")


@query("align_outer_interpolate", "series:s d:d v:f", GRID + """,
    n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d) AS p FROM g),
    m AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, last_value(v IGNORE NULLS) OVER a AS va,
      last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb, last_value(v IGNORE NULLS) OVER b AS vb
      FROM n WINDOW a AS (PARTITION BY series ORDER BY d), b AS (PARTITION BY series ORDER BY d DESC))
    SELECT series, d, coalesce(v, CASE WHEN pb IS NULL THEN va ELSE va + (vb - va) * (p - pa) / (pb - pa) END) AS v FROM m""")
def align_outer_interpolate(spark, sf):
    return align.align_series(_holed(spark, sf), "outer", "interpolate")


YOY = """WITH c AS ({src}),
    j AS (SELECT a.series, a.d, a.v, b.v AS pv, row_number() OVER (PARTITION BY a.series, a.d
        ORDER BY abs(date_diff('day', b.d, CAST(a.d - INTERVAL 12 MONTH AS DATE))), b.d DESC) AS rn
      FROM c a LEFT JOIN c b ON a.series = b.series AND abs(date_diff('day', b.d, CAST(a.d - INTERVAL 12 MONTH AS DATE))) <= 30)
    SELECT series, d, CASE WHEN month(d) NOT IN (1, 2) THEN {expr} END AS v FROM j WHERE rn = 1"""


@query("yoy_growth", "series:s d:d v:f", YOY.format(src="SELECT * FROM @cumulative", expr="(v - pv) / nullif(pv, 0) * 100"))
def yoy_growth(spark, sf):
    return align.year_on_year(bases.cumulative(spark, sf))


@query("yoy_growth_sparse", "series:s d:d v:f", YOY.format(src="SELECT * FROM @sparse", expr="(v - pv) / nullif(pv, 0) * 100"))
def yoy_growth_sparse(spark, sf):
    return align.year_on_year(bases.sparse(spark, sf))


@query("yoy_difference", "series:s d:d v:f", YOY.format(src="SELECT * FROM @sparse", expr="v - pv"))
def yoy_difference(spark, sf):
    return align.year_on_year(bases.sparse(spark, sf), difference=True)


@query("asof_backward", "series:s d:d v:f asof_t:d asof_state:f", """
    SELECT m.series, m.d, m.v, p.d AS asof_t, p.v AS asof_state FROM (SELECT series, last_day(d) AS d, sum(v) AS v FROM @panel GROUP BY 1, 2) m
    ASOF LEFT JOIN @panel p ON p.series = m.series AND m.d >= p.d""")
def asof_backward(spark, sf):
    """Month-end totals of every panel series beside its last weekly state."""
    panel = bases.panel(spark, sf)
    ends = panel.groupBy("series", F.last_day("d").alias("d")).agg(F.sum("v").alias("v"))
    return align.asof(ends, panel.select("series", F.col("d").alias("t"), F.col("v").alias("state")), ["series"], "d", "t", ["state"])


@query("lag_pairs", "candidate:s lag:n n:n sx:f sy:f", """
    WITH n AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY d) AS p, count(*) OVER (PARTITION BY series) AS n FROM @daily)
    SELECT y.series AS candidate, lag, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy
    FROM n y CROSS JOIN (SELECT CAST(unnest(range(-3, 4)) AS INT) AS lag) l JOIN n x ON x.series = '1-URGENT' AND x.p = y.p + lag
    WHERE y.series <> '1-URGENT' AND y.p <= least(x.n, y.n) AND x.p <= least(x.n, y.n) GROUP BY 1, 2""")
def lag_pairs(spark, sf):
    pairs = align.lag_pairs(bases.daily(spark, sf), "1-URGENT", 3)
    return pairs.groupBy("candidate", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


WEEKLY = f"""WITH w AS (SELECT series, {FRI.format(d='d')} AS d, arg_max(v, d) AS lv, arg_min(v, d) AS fv, min(d) AS fd, count(*) AS n
      FROM ({{src}}) WHERE v IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT s.series, p.d, lv, fv, fd, n FROM (SELECT DISTINCT series FROM ({{src}})) s CROSS JOIN ({SPINE}) p
      LEFT JOIN w ON w.series = s.series AND w.d = p.d),
    b AS (SELECT *, lv IS NULL AND coalesce(lead(n) OVER o, 0) >= 2 AS can, lead(fv) OVER o AS nv, lead(fd) OVER o AS nd
      FROM g WINDOW o AS (PARTITION BY series ORDER BY d)),
    aligned AS (SELECT series, d, CASE WHEN can THEN nv ELSE lv END AS v, CASE WHEN can THEN nd END AS borrowed_from FROM b)"""


@query("align_weekly_borrow", "series:s d:d v:f borrowed_from:d", WEEKLY.format(src="SELECT * FROM @sparse") + "SELECT * FROM aligned")
def align_weekly_borrow(spark, sf):
    return align.align_weekly(bases.sparse(spark, sf), *bounds(spark, sf))


@query("borrowing_log", "series:s borrowed_from:d borrowed_to:d", WEEKLY.format(src="SELECT * FROM @sparse")
       + "SELECT series, borrowed_from, d AS borrowed_to FROM aligned WHERE borrowed_from IS NOT NULL")
def borrowing_log(spark, sf):
    return align.borrowing_log(align.align_weekly(bases.sparse(spark, sf), *bounds(spark, sf)))


MOVE = """WITH r AS (SELECT series, {stamp} AS d, d AS o, v FROM @sparse),
    rows AS (SELECT series, d, {number} AS w, avg(v) AS v, count(v) AS n, first(v ORDER BY o) FILTER (v IS NOT NULL) AS fv FROM r GROUP BY 1, 2, 3),
    win AS (SELECT series, w, sum(n) AS n, max(d) AS td, min(d) FILTER (n > 0) AS dd, arg_min(fv, d) FILTER (n > 0) AS fv FROM rows GROUP BY 1, 2),
    x AS (SELECT *, lead(w) OVER o AS nw, lead(n) OVER o AS nn, lead(dd) OVER o AS ndd, lead(fv) OVER o AS nfv FROM win WINDOW o AS (PARTITION BY series ORDER BY w)),
    mv AS (SELECT * FROM x WHERE n = 0 AND nw = w + 1 AND nn >= 2)
    SELECT rows.series, rows.d, CASE WHEN t.series IS NOT NULL THEN t.nfv WHEN f.series IS NOT NULL THEN NULL ELSE rows.v END AS v
    FROM rows LEFT JOIN mv t ON t.series = rows.series AND t.td = rows.d LEFT JOIN mv f ON f.series = rows.series AND f.ndd = rows.d"""


@query("borrow_move_weekly", "series:s d:d v:f", MOVE.format(
    stamp=NEAREST.format(d="d"), number=f"date_diff('day', DATE '1970-01-02', {FRI.format(d=NEAREST.format(d='d'))}) // 7").replace(
    "date_diff('day', DATE '1970-01-02', CAST(CAST(d", "date_diff('day', DATE '1970-01-02', CAST(CAST(r.d"))
def borrow_move_weekly(spark, sf):
    return align.borrow_move(bases.sparse(spark, sf), "W")


@query("borrow_move_dekad", "series:s d:d v:f", MOVE.format(
    stamp="d", number="(year(r.d) * 12 + month(r.d)) * 3 + least((day(r.d) - 1) // 10, 2) + 1"))
def borrow_move_dekad(spark, sf):
    return align.borrow_move(bases.sparse(spark, sf), "K")


@query("daily_to_weekly", "series:s d:d v:f", f"SELECT series, {FRI.format(d='d')} AS d, avg(v) AS v FROM @daily GROUP BY series, {FRI.format(d='d')}")
def daily_to_weekly(spark, sf):
    return align.daily_to_weekly(bases.daily(spark, sf))


def _friday_query(name, period, unit):
    @query(name, "series:s d:d v:f", f"""SELECT series, f AS d, arg_max(v, d) FILTER (v IS NOT NULL) AS v
        FROM (SELECT series, d, v, {clamp_sql('d', unit) if unit else NEAREST.format(d='d')} AS f FROM @sparse) GROUP BY 1, 2""")
    def run(spark, sf):
        return align.periodic_to_friday(bases.sparse(spark, sf), period)


for _n, _p, _u in (("target_to_friday", None, None), ("monthly_to_friday", "month", "month"),
                   ("quarterly_to_friday", "quarter", "quarter"), ("yearly_to_friday", "year", "year")):
    _friday_query(_n, _p, _u)

DEKAD_SRC = f"""SELECT series, f AS d, arg_max(v, d) FILTER (v IS NOT NULL) AS v FROM (SELECT series, d, v, {clamp_sql('d', 'month', DEKAD_FRI)} AS f
    FROM @daily WHERE day(d) IN (10, 20) OR d = last_day(d)) GROUP BY 1, 2"""


@query("dekad_to_weekly", "series:s d:d v:f borrowed_from:d", WEEKLY.format(src=DEKAD_SRC) + "SELECT * FROM aligned")
def dekad_to_weekly(spark, sf):
    return align.dekad_to_weekly(bases.daily(spark, sf), *bounds(spark, sf))


def _mixed(spark, sf):
    """Series of every frequency, cut from the daily totals."""
    daily = bases.daily(spark, sf)
    d = F.col("d")
    keep = {"D": F.lit(True), "W": F.weekday(d) == 2, "K": cal.is_dekad_date(d), "M": d == F.last_day(d),
            "Q": (d == F.last_day(d)) & (F.month(d) % 3 == 0), "Y": (F.month(d) == 12) & (F.day(d) == 31)}
    out = None
    for freq, rule in keep.items():
        part = daily.filter(rule).select(F.concat(F.lit(freq + ":"), "series").alias("series"), "d", "v", F.lit(freq).alias("freq"))
        out = part if out is None else out.unionByName(part)
    return out


MIXED = " UNION ALL ".join(f"SELECT '{f}:' || series AS series, d, v, '{f}' AS freq FROM @daily WHERE {rule}" for f, rule in (
    ("D", "true"), ("W", "isodow(d) = 3"), ("K", "day(d) IN (10, 20) OR d = last_day(d)"), ("M", "d = last_day(d)"),
    ("Q", "d = last_day(d) AND month(d) % 3 = 0"), ("Y", "month(d) = 12 AND day(d) = 31")))


def aligned_sql(threshold):
    """Aligned and gated rows of the mixed series: ``al`` without ``bad``."""
    return f"""mx AS ({MIXED}),
    dd AS (SELECT series, {FRI.format(d='d')} AS d, avg(v) AS v FROM mx WHERE freq = 'D' GROUP BY 1, 2),
    ww AS ({WEEKLY.format(src="SELECT * FROM mx WHERE freq = 'W'")} SELECT series, d, v FROM aligned),
    kk AS ({WEEKLY.format(src=DEKAD_SRC.replace('@daily', "(SELECT * FROM mx WHERE freq = 'K')"))} SELECT series, d, v FROM aligned),
    pp AS (SELECT series, freq, CASE freq WHEN 'M' THEN {clamp_sql('d', 'month')} WHEN 'Q' THEN {clamp_sql('d', 'quarter')} ELSE {clamp_sql('d', 'year')} END AS d, v FROM mx WHERE freq IN ('M', 'Q', 'Y')),
    al AS (SELECT series, d, v, 'D' AS freq FROM dd UNION ALL SELECT series, d, v, 'W' FROM ww UNION ALL SELECT series, d, v, 'K' FROM kk UNION ALL SELECT series, d, v, freq FROM pp),
    ranged AS (SELECT * FROM al WHERE freq IN ('M', 'Q', 'Y') OR d BETWEEN (SELECT lo FROM {RANGE}) AND (SELECT hi FROM {RANGE})),
    isl AS (SELECT series, d, v, count(v) OVER (PARTITION BY series ORDER BY d) AS i, count(v) OVER (PARTITION BY series) AS c FROM ranged),
    bad AS (SELECT DISTINCT series FROM (SELECT series, i, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS k FROM isl WHERE i > 0 OR c = 0 GROUP BY 1, 2) WHERE k >= {threshold})"""


@query("align_by_frequency", "series:s freq:s n:n total:f first_d:d last_d:d", f"""
    WITH {aligned_sql(4)}
    SELECT series, freq, count(v) AS n, sum(v) AS total, min(d) AS first_d, max(d) AS last_d FROM al WHERE series NOT IN (SELECT series FROM bad) GROUP BY 1, 2""")
def align_by_frequency(spark, sf):
    out = align.align_and_gate(_mixed(spark, sf), 4, *bounds(spark, sf))
    return out.groupBy("series", "freq").agg(F.count("v").alias("n"), F.sum("v").alias("total"),
                                             F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("infer_frequency", "series:s days:n label:s", f"""
    WITH g AS (SELECT series, date_diff('day', lag(d) OVER (PARTITION BY series ORDER BY d), d) AS gap FROM ({MIXED} UNION ALL SELECT series, d, v, '' FROM @sparse WHERE v IS NOT NULL)),
    m AS (SELECT series, CAST(floor(median(gap)) AS BIGINT) AS days FROM g GROUP BY 1)
    SELECT series, days, CASE WHEN days IS NULL THEN 'Undetermined' WHEN days BETWEEN 0.8 AND 1.2 THEN 'Daily' WHEN days BETWEEN 5 AND 7.9 THEN 'Weekly'
      WHEN days BETWEEN 8 AND 24 THEN 'Ten_Day' WHEN days BETWEEN 25 AND 35 THEN 'Monthly' WHEN days BETWEEN 85 AND 100 THEN 'Quarterly'
      WHEN days BETWEEN 350 AND 380 THEN 'Annual' ELSE 'Irregular' END AS label FROM m""")
def infer_frequency(spark, sf):
    return align.infer_frequency(_mixed(spark, sf).drop("freq").unionByName(bases.sparse(spark, sf)))


BUCKETS = {"Weekly": "CAST(d + CAST((8 - isodow(d)) % 7 AS INTEGER) AS DATE)", "Monthly": "last_day(d)",
           "Quarterly": "CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
           "Annual": "CAST(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)",
           "Ten_Day": "CAST((SELECT min(d) FROM @sparse) + CAST(date_diff('day', (SELECT min(d) FROM @sparse), d) // 10 * 10 AS INTEGER) AS DATE)"}
PICKS = {"mean": "avg(v)", "last": "arg_max(v, d)", "first": "arg_min(v, d)", "median": "median(v)"}


def _resample_query(label, method):
    @query(f"resample_{label.lower()}_{method}", "series:s d:d v:f", f"""SELECT series, b AS d, {PICKS[method]} AS v
        FROM (SELECT series, d, v, {BUCKETS[label]} AS b FROM @sparse) WHERE v IS NOT NULL GROUP BY 1, 2""")
    def run(spark, sf):
        return align.resample(bases.sparse(spark, sf), label, method)


for _l, _m in (("Weekly", "mean"), ("Ten_Day", "last"), ("Monthly", "first"), ("Quarterly", "median"), ("Annual", "mean")):
    _resample_query(_l, _m)


@query("resample_weekly_sum", "series:s d:d v:f", f"""
    WITH g AS (SELECT series, {BUCKETS['Weekly']} AS b, sum(v) AS v FROM @sparse GROUP BY 1, 2)
    SELECT s.series, CAST(p.x AS DATE) AS d, coalesce(g.v, 0.0) AS v FROM (SELECT DISTINCT series FROM g) s
    CROSS JOIN (SELECT unnest(generate_series(CAST(min(b) AS TIMESTAMP), CAST(max(b) AS TIMESTAMP), INTERVAL 7 DAY)) AS x FROM g) p
    LEFT JOIN g ON g.series = s.series AND g.b = CAST(p.x AS DATE)""")
def resample_weekly_sum(spark, sf):
    return align.resample(bases.sparse(spark, sf), "Weekly", "sum")


@query("unify_frequencies", "series:s d:d v:f", f"""SELECT series, CAST(date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS d, avg(v) AS v
    FROM ({MIXED}) GROUP BY 1, 2""")
def unify_frequencies(spark, sf):
    return align.unify_frequencies(_mixed(spark, sf).drop("freq"))


def _monthly_apart(spark, sf):
    """All monthly series, one of them in mid-month, so that no date is common to all."""
    day = F.when(F.col("series") == "2-HIGH", F.date_add("d", 14)).otherwise(F.col("d"))
    return bases.monthly(spark, sf).withColumn("d", day)


@query("unify_for_pairs", "series:s d:d v:f", "SELECT series, last_day(d) AS d, avg(v) AS v FROM @monthly GROUP BY 1, 2")
def unify_for_pairs(spark, sf):
    return align.unify_for_pairs(_monthly_apart(spark, sf))


@query("date_overlap", "n_common:n longest:n overlap:f", """
    WITH v AS (SELECT * FROM @sparse WHERE v IS NOT NULL), l AS (SELECT max(n) AS longest, count(*) AS k FROM (SELECT count(*) AS n FROM v GROUP BY series)),
    c AS (SELECT count(*) AS n_common FROM (SELECT d FROM v GROUP BY d HAVING count(*) = (SELECT k FROM l)))
    SELECT n_common, longest, n_common / longest AS overlap FROM c, l""")
def date_overlap(spark, sf):
    return align.date_overlap(bases.sparse(spark, sf))


@query("common_dates", "d:d", "SELECT d FROM @panel GROUP BY d HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM @panel)")
def common_dates(spark, sf):
    return align.common_dates(bases.panel(spark, sf))
