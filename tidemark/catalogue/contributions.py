"""Weights, contributions, ratios."""

from pyspark.sql import functions as F

from tidemark.catalogue import bases
from tidemark.catalogue.alignment import YOY
from tidemark.catalogue.registry import query
from tidemark.operators import contribution as con

GROUP_SQL = """groups AS (SELECT DISTINCT 'export_dependence' AS attribute, export_dependence AS grp, indicator FROM @weights_wide WHERE export_dependence IS NOT NULL
    UNION ALL SELECT DISTINCT 'stream', stream, indicator FROM @weights_wide WHERE stream IS NOT NULL
    UNION ALL SELECT DISTINCT 'sector', sector, indicator FROM @weights_wide WHERE sector IS NOT NULL)"""


@query("effective_weights", "indicator:s d:d v:f weight:f", "SELECT * FROM @weighted")
def effective_weights(spark, sf):
    return con.effective_weights(bases.nations(spark, sf), bases.weights(spark, sf))


@query("grouping_map", "attribute:s grp:s indicator:s", f"WITH {GROUP_SQL} SELECT * FROM groups")
def grouping_map(spark, sf):
    return con.grouping_map(bases.weights(spark, sf))


@query("grouping_annotation", "grp:s indicator:s weights:s", """SELECT stream AS grp, indicator,
    format('1996={:.4f};1998={:.4f};2000={:.4f}', "权重_1996", coalesce("权重_1998", 0), "权重_2000") AS weights FROM @weights_wide WHERE stream IS NOT NULL""")
def grouping_annotation(spark, sf):
    return con.grouping_annotation(bases.weights(spark, sf), "stream")


@query("group_details", "grp:s n:n total_weight:f", """SELECT stream AS grp, count(*) AS n, coalesce(sum("权重_1998"), 0) AS total_weight
    FROM @weights_wide WHERE stream IS NOT NULL GROUP BY 1""")
def group_details(spark, sf):
    return con.group_details(bases.weights(spark, sf), "stream", 1998)


@query("weighted_groups", "d:d attribute:s grp:s v:f", f"""WITH {GROUP_SQL} SELECT d, attribute, grp, nullif(sum(v * weight), 0) AS v
    FROM @weighted JOIN groups USING (indicator) WHERE attribute <> 'sector' AND year(d) >= 1996 GROUP BY 1, 2, 3""")
def weighted_groups(spark, sf):
    return con.weighted_groups(bases.nations(spark, sf), bases.weights(spark, sf), min_year=1996)


@query("individual_contributions", "indicator:s d:d contribution:f", "SELECT indicator, d, v * weight AS contribution FROM @weighted")
def individual_contributions(spark, sf):
    return con.individual_contributions(bases.nations(spark, sf), bases.weights(spark, sf))


DENSE = f"""WITH {GROUP_SQL}, grid AS (SELECT i.indicator, c.d, n.v, coalesce((SELECT arg_max(w.weight, w.weight_year) FROM @weights w
      WHERE w.indicator = i.indicator AND w.weight IS NOT NULL AND w.weight_year <= year(c.d)), 0.0) AS weight
    FROM (SELECT DISTINCT indicator FROM @nations) i CROSS JOIN (SELECT DISTINCT d FROM @nations) c LEFT JOIN @nations n ON n.indicator = i.indicator AND n.d = c.d),
    gc AS (SELECT attribute, grp, d, coalesce(sum(v * weight), 0) AS contribution, sum(weight) AS tw FROM grid JOIN groups USING (indicator) GROUP BY 1, 2, 3)"""


@query("group_contributions", "attribute:s grp:s d:d contribution:f", DENSE + "SELECT * FROM gc")
def group_contributions(spark, sf):
    return con.group_contributions(bases.nations(spark, sf), bases.weights(spark, sf))


@query("sector_contributions_overall", "attribute:s grp:s d:d contribution:f", DENSE + """,
    o AS (SELECT r_name AS sector, d, avg(n.v) AS v FROM @nations n JOIN nation ON n_name = indicator JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2 GROUP BY 1, 2)
    SELECT attribute, grp, gc.d, CASE WHEN attribute = 'sector' AND grp IN (SELECT sector FROM o) THEN o.v * tw ELSE contribution END AS contribution
    FROM gc LEFT JOIN o ON attribute = 'sector' AND o.sector = grp AND o.d = gc.d""")
def sector_contributions_overall(spark, sf):
    nation, region = bases.table(spark, sf, "nation"), bases.table(spark, sf, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_regionkey <= 2")
    obs = bases.nations(spark, sf)
    overall = obs.join(place, F.col("n_name") == F.col("indicator")).groupBy(
        F.col("r_name").alias("sector"), "d").agg(F.avg("v").alias("v"))
    return con.group_contributions(obs, bases.weights(spark, sf), overall)


@query("validate_contributions", "max_diff:f mean_diff:f worst_date:d passed:b", """
    WITH s AS (SELECT d, sum(v * weight) AS s FROM @weighted GROUP BY 1), t AS (SELECT d, sum(v) * 0.5 AS v FROM @nations GROUP BY 1),
    x AS (SELECT t.d, abs(coalesce(s, 0) - v) AS diff FROM t LEFT JOIN s USING (d))
    SELECT max(diff) AS max_diff, avg(diff) AS mean_diff, arg_max(d, diff) AS worst_date, max(diff) <= 0.5 AS passed FROM x""")
def validate_contributions(spark, sf):
    obs = bases.nations(spark, sf)
    total = obs.groupBy("d").agg((F.sum("v") * 0.5).alias("v"))
    return con.validate_contributions(con.individual_contributions(obs, bases.weights(spark, sf)), total)


PROFIT = """profit AS (SELECT indicator AS industry, d, sum(v) OVER (PARTITION BY indicator, year(d) ORDER BY d) AS v FROM @nations),
    ic AS (SELECT c.industry, c.d, (c.v - b.v) / nullif(t.total, 0) * 100 AS contribution FROM profit c
      LEFT JOIN profit b ON b.industry = c.industry AND b.d = c.d - INTERVAL 12 MONTH
      LEFT JOIN (SELECT d, sum(v) AS total FROM profit GROUP BY 1) t ON t.d = b.d WHERE month(c.d) NOT IN (1, 2))"""


def _profit(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("indicator", F.year("d")).orderBy("d")
    return bases.nations(spark, sf).select(F.col("indicator").alias("industry"), "d", F.sum("v").over(w).alias("v"))


@query("profit_contributions", "industry:s d:d contribution:f", f"WITH {PROFIT} SELECT * FROM ic")
def profit_contributions(spark, sf):
    return con.profit_contributions(_profit(spark, sf))


def _long_weights(spark, sf):
    """Weights named like published indicators, the industry inside the name."""
    return bases.weights(spark, sf).withColumn("indicator", F.concat(F.lit("规模以上:"), "indicator", F.lit(" 、及:当月同比")))


def _names(spark, sf):
    """Half the industries are written with a separator only loose matching ignores."""
    n = bases.table(spark, sf, "nation")
    return n.select(F.when(F.col("n_regionkey") < 2, F.concat("n_name", F.lit("、及"))).otherwise(F.concat("n_name", F.lit(" "))).alias("industry"))


@query("match_names", "industry:s indicator:s", """
    WITH w AS (SELECT DISTINCT '规模以上:' || indicator || ' 、及:当月同比' AS indicator, pos FROM @weights_wide),
    n AS (SELECT CASE WHEN n_regionkey < 2 THEN n_name || '、及' ELSE n_name || ' ' END AS industry FROM nation),
    h AS (SELECT industry, indicator, pos, 0 AS loose FROM n JOIN w ON contains(indicator, industry)
      UNION ALL SELECT industry, indicator, pos, 1 FROM n JOIN w ON contains(translate(indicator, '、，。及和的 　', ''), translate(industry, '、，。及和的 　', '')))
    SELECT industry, arg_min(indicator, (loose, pos)) AS indicator FROM h GROUP BY 1""")
def match_names(spark, sf):
    return con.match_names(_names(spark, sf), _long_weights(spark, sf))


@query("stream_profit_contributions", "stream:s d:d contribution:f", f"""WITH {PROFIT},
    m AS (SELECT n.n_name AS industry, arg_min(w.indicator, w.pos) AS indicator FROM nation n JOIN @weights_wide w ON contains(w.indicator, n.n_name) GROUP BY 1)
    SELECT stream, d, coalesce(sum(contribution), 0) AS contribution FROM ic JOIN m USING (industry) JOIN @weights_wide w ON w.indicator = m.indicator WHERE stream IS NOT NULL GROUP BY 1, 2""")
def stream_profit_contributions(spark, sf):
    individual = con.profit_contributions(_profit(spark, sf))
    names = bases.table(spark, sf, "nation").select(F.col("n_name").alias("industry"))
    return con.stream_profit_contributions(individual, names, bases.weights(spark, sf))


@query("profit_total_growth", "d:d v:f", "WITH y AS (" + YOY.format(
    src="SELECT 'total' AS series, d, sum(v) AS v FROM (SELECT d, sum(v) OVER (PARTITION BY indicator, year(d) ORDER BY d) AS v FROM @nations) GROUP BY 2",
    expr="(v - pv) / nullif(pv, 0) * 100") + ") SELECT d, v FROM y WHERE month(d) NOT IN (1, 2)")
def profit_total_growth(spark, sf):
    return con.profit_total_growth(_profit(spark, sf))


CHANGE = """c AS (SELECT indicator, d, v * weight AS contribution FROM @weighted),
    l AS (SELECT max(d) AS l1, max(d) FILTER (d < (SELECT max(d) FROM c)) AS l2 FROM c),
    ch AS (SELECT indicator, max(contribution) FILTER (d = l1) AS latest, max(contribution) FILTER (d = l2) AS previous,
      max(contribution) FILTER (d = l1) - max(contribution) FILTER (d = l2) AS change FROM c, l WHERE d IN (l1, l2) GROUP BY 1)"""


@query("monthly_change", "indicator:s latest:f previous:f change:f", f"WITH {CHANGE} SELECT * FROM ch")
def monthly_change(spark, sf):
    return con.monthly_change(con.individual_contributions(bases.nations(spark, sf), bases.weights(spark, sf)))


@query("change_counts", "attribute:s grp:s n_up:n n_down:n", f"""WITH {GROUP_SQL}, {CHANGE} SELECT attribute, grp, count(*) FILTER (change > 0) AS n_up,
    count(*) FILTER (change < 0) AS n_down FROM groups LEFT JOIN ch USING (indicator) WHERE attribute <> 'sector' GROUP BY 1, 2""")
def change_counts(spark, sf):
    w = bases.weights(spark, sf)
    return con.change_counts(con.monthly_change(con.individual_contributions(bases.nations(spark, sf), w)), w)


@query("contribution_ranks", "indicator:s d:d contribution:f rank:n", """SELECT indicator, d, v * weight AS contribution,
    rank() OVER (PARTITION BY d ORDER BY abs(v * weight) DESC) AS rank FROM @weighted""")
def contribution_ranks(spark, sf):
    return con.contribution_ranks(con.individual_contributions(bases.nations(spark, sf), bases.weights(spark, sf)))


@query("operating_ratios", "d:d roe:f margin:f turnover:f multiplier:f", """
    WITH cur AS (SELECT series, d, coalesce(v - lag(v) OVER (PARTITION BY series ORDER BY d), v) AS v FROM @cumulative WHERE series IN ('1-URGENT', '2-HIGH')),
    w AS (SELECT d, max(v) FILTER (series = '1-URGENT') AS p, max(v) FILTER (series = '2-HIGH') AS r, max(v) FILTER (series = '3-MEDIUM') AS a, max(v) FILTER (series = '5-LOW') AS e
      FROM (SELECT * FROM cur UNION ALL SELECT series, d, v FROM @monthly WHERE series IN ('3-MEDIUM', '5-LOW')) GROUP BY 1)
    SELECT d, p / nullif(e, 0) * 100 AS roe, p / nullif(r, 0) * 100 AS margin, r / nullif(a, 0) AS turnover, a / nullif(e, 0) AS multiplier FROM w WHERE month(d) NOT IN (1, 2)""")
def operating_ratios(spark, sf):
    return con.operating_ratios(bases.cumulative(spark, sf), bases.monthly(spark, sf), "1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("efficiency_growth", "series:s d:d v:f", "WITH y AS (" + YOY.format(src="SELECT * FROM @cumulative", expr="(v - pv) / nullif(pv, 0) * 100")
       + ") SELECT * FROM y WHERE month(d) NOT IN (1, 2)")
def efficiency_growth(spark, sf):
    return con.efficiency_growth(bases.cumulative(spark, sf))


@query("profit_indicators", "series:s d:d v:f", "WITH y AS (" + YOY.format(
    src="SELECT * FROM @cumulative", expr="CASE WHEN series = '5-LOW' THEN v - pv ELSE (v - pv) / nullif(pv, 0) * 100 END")
       + ") SELECT * FROM y WHERE month(d) NOT IN (1, 2)")
def profit_indicators(spark, sf):
    return con.profit_indicators(bases.cumulative(spark, sf), "5-LOW")
