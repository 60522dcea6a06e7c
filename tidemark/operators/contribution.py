"""Effective-dated weights, growth contributions, profit and efficiency ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import strip_separators
from tidemark.operators import align, window
from tidemark.operators.rank import rank_descending

GROUPINGS = ("export_dependence", "stream", "sector")


def _calendar(obs: DataFrame) -> Column:
    """Sorted dates of the frame as one array, bounded by the calendar."""
    return obs.select(F.sort_array(F.collect_set("d"))).scalar()


def densify(obs: DataFrame) -> DataFrame:
    """Every indicator on every date of the frame, missing values null."""
    names = obs.select("indicator").distinct()
    grid = names.select("indicator", F.explode(_calendar(obs)).alias("d"))
    return grid.join(obs, ["indicator", "d"], "left")


def effective_weights(obs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds the latest non-null weight not after each row's year; 0 before the first.

    Each indicator's dated weights travel as one short sorted array, so the
    join is plain equality and never multiplies rows.  Indicators without a
    weight row drop out."""
    dated = weights.groupBy("indicator").agg(F.array_sort(F.collect_list(
        F.when(F.col("weight").isNotNull(), F.struct("weight_year", "weight")))).alias("_w"))
    year = F.year("d")
    usable = F.filter("_w", lambda x: x["weight_year"] <= year)
    chosen = F.element_at(F.transform(usable, lambda x: x["weight"]), -1)
    return (obs.join(dated, "indicator")
            .withColumn("weight", F.coalesce(F.when(F.size(usable) > 0, chosen), F.lit(0.0))).drop("_w"))


def grouping_map(weights: DataFrame) -> DataFrame:
    """``(attribute, grp, indicator)`` for the grouping attributes; null groups drop."""
    one = weights.select("indicator", *GROUPINGS).distinct()
    return (one.unpivot(["indicator"], list(GROUPINGS), "attribute", "grp").filter(F.col("grp").isNotNull()))


def grouping_annotation(weights: DataFrame, attribute: str) -> DataFrame:
    """Members of each group with every dated weight printed to four decimals."""
    texts = weights.filter(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("grp"), "indicator").agg(
        F.array_sort(F.collect_list(F.struct("weight_year", F.format_string(
            "%.4f", F.coalesce("weight", F.lit(0.0))).alias("t")))).alias("w"))
    return texts.select("grp", "indicator", F.array_join(F.transform("w", lambda x: F.concat_ws(
        "=", x["weight_year"].cast("string"), x["t"])), ";").alias("weights"))


def group_details(weights: DataFrame, attribute: str, weight_year: int) -> DataFrame:
    """Indicator count and total weight of one year per group."""
    rows = weights.filter((F.col("weight_year") == weight_year) & F.col(attribute).isNotNull())
    return rows.groupBy(F.col(attribute).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def weighted_groups(obs: DataFrame, weights: DataFrame, attributes=("export_dependence", "stream"),
                    min_year: int = 2012) -> DataFrame:
    """Weighted sums per date and group, nulls skipped, exact zeros null."""
    recent = obs.filter(F.year("d") >= min_year)
    rows = effective_weights(recent, weights).join(
        grouping_map(weights).filter(F.col("attribute").isin(list(attributes))), "indicator")
    total = F.sum(F.col("v") * F.col("weight"))
    return rows.groupBy("d", "attribute", "grp").agg(F.nullif(total, F.lit(0.0)).alias("v"))


def individual_contributions(obs: DataFrame, weights: DataFrame) -> DataFrame:
    return effective_weights(obs, weights).select("indicator", "d", (F.col("v") * F.col("weight")).alias("contribution"))


def group_contributions(obs: DataFrame, weights: DataFrame, overall: DataFrame | None = None) -> DataFrame:
    """Contribution of every group on every date of the frame.

    Sums skip nulls and are 0 where nothing is valid.  A sector present in
    ``overall(sector, d, v)`` uses its overall growth times its total weight."""
    dense = densify(obs)
    rows = effective_weights(dense, weights).join(grouping_map(weights), "indicator")
    out = rows.groupBy("attribute", "grp", "d").agg(
        F.coalesce(F.sum(F.col("v") * F.col("weight")), F.lit(0.0)).alias("contribution"),
        F.sum("weight").alias("total_weight"))
    if overall is None:
        return out.drop("total_weight")
    known = overall.select(F.lit("sector").alias("attribute"), F.col("sector").alias("grp")).distinct().withColumn("_known", F.lit(True))
    growth = overall.select(F.lit("sector").alias("attribute"), F.col("sector").alias("grp"), "d", F.col("v").alias("_g"))
    joined = out.join(known, ["attribute", "grp"], "left").join(growth, ["attribute", "grp", "d"], "left")
    return joined.select("attribute", "grp", "d", F.when(
        F.coalesce("_known", F.lit(False)), F.col("_g") * F.col("total_weight")).otherwise(F.col("contribution")).alias("contribution"))


def validate_contributions(contributions: DataFrame, total: DataFrame,
                           tolerance: float = vocab.CONTRIBUTION_TOLERANCE) -> DataFrame:
    """Largest and mean distance of summed contributions from total growth."""
    summed = contributions.groupBy("d").agg(F.sum("contribution").alias("s"))
    diff = F.abs(F.coalesce("s", F.lit(0.0)) - F.col("v"))
    out = total.select("d", "v").join(summed, "d", "left").withColumn("diff", diff).agg(
        F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"),
        F.max_by("d", F.struct("diff", (-F.datediff("d", F.lit("1970-01-01").cast("date"))).alias("early"))).alias("worst_date"))
    return out.withColumn("passed", F.col("max_diff") <= tolerance)


GRAM = 3


def _grams(c: Column, sizes: Column) -> Column:
    """Distinct character sequences of the given lengths, in work linear in the text."""
    def of_length(chars, n):
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))
    chars = F.split(c, "")
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: of_length(chars, n))))


def match_names(names: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight indicator whose name contains each industry name.

    Postings of short character sequences of the weight names stand for their
    substrings: an industry name is looked up by the rarest of its own
    sequences, in the names that hold it, and verified there.  A plain match
    beats one that ignores separators; the earliest weight row wins."""
    w = weights.filter(F.col("indicator").isNotNull()).groupBy("indicator").agg(F.min("pos").alias("pos")).withColumn("_id", F.xxhash64("indicator"))
    both = lambda df, name: df.withColumn("_text", F.col(name)).withColumn("loose", F.lit(0)).unionByName(
        df.withColumn("_text", strip_separators(F.col(name))).withColumn("loose", F.lit(1))).filter("_text <> ''")
    texts = both(w, "indicator")
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    postings = texts.select("loose", "_id", F.explode(_grams(F.col("_text"), sizes)).alias("_gram"))
    often = postings.groupBy("loose", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    wanted = both(names.select("industry").distinct(), "industry").withColumnRenamed("_text", "_key")
    own = wanted.withColumn("_gram", F.explode(_grams(F.col("_key"), F.array(F.least(F.length("_key"), F.lit(GRAM))))))
    rarest = own.join(often, ["loose", "_gram"], "left").groupBy("industry", "loose", "_key").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("r")).filter("r.n > 0")
    found = rarest.select("industry", "loose", "_key", F.col("r._gram").alias("_gram")).join(postings, ["loose", "_gram"])
    hits = found.join(texts, ["loose", "_id"]).filter(F.contains("_text", "_key"))
    return hits.groupBy("industry").agg(F.min_by("indicator", F.struct("loose", "pos", "indicator")).alias("indicator"))


def profit_contributions(profit: DataFrame) -> DataFrame:
    """100 * (current - a year earlier) / total a year earlier, per industry.

    ``profit(industry, d, v)`` holds cumulative values; January and February
    are removed and the base is the exact date twelve months before."""
    kept = profit.filter(~F.month("d").isin(1, 2))
    totals = kept.groupBy("d").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("_total"))
    base = (kept.join(totals, "d").select("industry", F.add_months("d", 12).alias("d"),
                                          F.col("v").alias("_base"), "_total"))
    # Where the base date exists for other industries but not this one, the row is null.
    joined = kept.join(base, ["industry", "d"], "left")
    return joined.select("industry", "d", (F.try_divide(F.col("v") - F.col("_base"), F.col("_total")) * 100).alias("contribution"))


def stream_profit_contributions(individual: DataFrame, names: DataFrame, weights: DataFrame) -> DataFrame:
    """Roll industry contributions up to the stream of their matched weight row."""
    stream = weights.select("indicator", "stream").distinct().filter(F.col("stream").isNotNull())
    mapped = match_names(names, weights).join(stream, "indicator").select("industry", "stream")
    return individual.join(mapped, "industry").groupBy("stream", "d").agg(
        F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("contribution"))


def profit_total_growth(profit: DataFrame) -> DataFrame:
    """Growth of the summed cumulative profit, January and February removed."""
    total = profit.groupBy("d").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v")).withColumn("series", F.lit("total"))
    return align.year_on_year(total).filter(~F.month("d").isin(1, 2)).select("d", "v")


def monthly_change(contributions: DataFrame) -> DataFrame:
    """Contribution of each indicator in the two latest months, and the change."""
    latest = contributions.select(F.max("d")).scalar()
    before = contributions.filter(F.col("d") < latest).select(F.max("d")).scalar()
    recent = contributions.filter((F.col("d") == latest) | (F.col("d") == before))
    out = recent.groupBy("indicator").agg(
        F.max(F.when(F.col("d") == latest, F.col("contribution"))).alias("latest"),
        F.max(F.when(F.col("d") == before, F.col("contribution"))).alias("previous"))
    return out.withColumn("change", F.col("latest") - F.col("previous"))


def change_counts(changes: DataFrame, weights: DataFrame, attributes=("export_dependence", "stream")) -> DataFrame:
    """Indicators pulling up and down in each group."""
    groups = grouping_map(weights).filter(F.col("attribute").isin(list(attributes)))
    return groups.join(changes, "indicator", "left").groupBy("attribute", "grp").agg(
        F.count_if(F.col("change") > 0).alias("n_up"), F.count_if(F.col("change") < 0).alias("n_down"))


def contribution_ranks(contributions: DataFrame) -> DataFrame:
    """Rank by absolute contribution among all indicators of each date, 1 largest."""
    return rank_descending(contributions, ["d"], F.abs("contribution"))


def operating_ratios(cumulative: DataFrame, stock: DataFrame, profit: str, revenue: str,
                     assets: str, equity: str) -> DataFrame:
    """Return on equity, margin, asset turnover and equity multiplier by date.

    Profit and revenue are cumulative and turned into current values first;
    January and February are dropped afterwards."""
    flows = window.cumulative_to_current(cumulative.filter(F.col("series").isin(profit, revenue)))
    pick = lambda n, a: F.max(F.when(F.col("series") == n, F.col("v"))).alias(a)
    wide = flows.unionByName(stock.filter(F.col("series").isin(assets, equity)).select(*flows.columns)).groupBy("d").agg(
        pick(profit, "profit"), pick(revenue, "revenue"), pick(assets, "assets"), pick(equity, "equity"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return wide.filter(~F.month("d").isin(1, 2)).select(
        "d", (ratio("profit", "equity") * 100).alias("roe"), (ratio("profit", "revenue") * 100).alias("margin"),
        ratio("revenue", "assets").alias("turnover"), ratio("assets", "equity").alias("multiplier"))


def efficiency_growth(metrics: DataFrame) -> DataFrame:
    """Year-on-year growth of each efficiency ratio without January and February."""
    return align.year_on_year(metrics).filter(~F.month("d").isin(1, 2))


def profit_indicators(obs: DataFrame, margin: str) -> DataFrame:
    """Profit table: growth of every series, but point difference for the margin."""
    rest = align.year_on_year(obs.filter(F.col("series") != margin))
    points = align.year_on_year(obs.filter(F.col("series") == margin), difference=True)
    return rest.unionByName(points).filter(~F.month("d").isin(1, 2))
