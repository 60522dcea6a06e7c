"""Input audits: format, samples, schema and dictionary consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import text


def gap_label(days: Column) -> Column:
    return (F.when(days.isNull(), "unknown").when(days == 1, "daily").when(days == 7, "weekly")
            .when(days.between(28, 31), "monthly").when(days.between(90, 92), "quarterly")
            .when(days.between(365, 366), "yearly")
            .otherwise(F.concat(F.lit("custom ("), days.cast("string"), F.lit(" days)"))))


def time_series_audit(obs: DataFrame) -> DataFrame:
    """Per series: rows, missing share, duplicate stamps, irregular gaps, modal gap.

    Counts come from one aggregation per ``(series, d)``; a repeated stamp adds
    gaps of zero days, so gap moments need no sort of the raw rows beyond one
    row per date.  All figures go on from there in one pass, without a join."""
    per_date = obs.groupBy("series", "d").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"))
    w = Window.partitionBy("series").orderBy("d")
    stepped = per_date.withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    # A date held n times contributes its real gap once and n-1 zero gaps; its counts go with the real one.
    none = F.lit(0).cast("long")
    modes = (stepped.select("series", "d", F.explode(F.array(
        F.struct(F.col("gap"), F.when(F.col("gap").isNotNull(), 1).otherwise(0).alias("k"), F.col("n"), F.col("n_valid"), F.lit(1).alias("dates")),
        F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).cast("int").alias("k"), none.alias("n"), none.alias("n_valid"), F.lit(0).alias("dates")))).alias("g"))
        .groupBy("series", "g.gap").agg(F.sum("g.k").alias("k"), F.sum("g.n").alias("n"), F.sum("g.n_valid").alias("n_valid"),
                                        F.sum("g.dates").alias("dates"), F.min("d").alias("lo"), F.max("d").alias("hi")))
    k, g = F.col("k"), F.col("gap")
    n_gaps = F.nullif(F.sum(k), F.lit(0))
    out = modes.groupBy("series").agg(
        F.min_by("gap", F.when(k > 0, F.struct(-k, g))).alias("mode_gap"), (F.sum(k * g) / n_gaps).alias("mean_gap"),
        F.sqrt(F.greatest(F.sum(k * g * g) - F.sum(k * g) * F.sum(k * g) / n_gaps, F.lit(0.0))
               / F.nullif(n_gaps - 1, F.lit(0))).alias("std_gap"),
        F.sum("n").alias("n_rows"), (F.sum("n") - F.sum("n_valid")).alias("n_missing"),
        (F.sum("n") - F.sum("dates")).alias("n_duplicates"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))
    pct = F.col("n_missing") * 100.0 / F.col("n_rows")
    return out.select(
        "series", "n_rows", "first_date", "last_date", pct.alias("missing_pct"),
        (pct > 50).alias("too_sparse"), "n_duplicates",
        F.coalesce(F.col("std_gap") > F.col("mean_gap") * 0.1, F.lit(False)).alias("irregular"),
        gap_label(F.col("mode_gap")).alias("frequency"))


def series_gate(obs: DataFrame, min_samples: int = vocab.MIN_CORRELATION_SAMPLES) -> DataFrame:
    """Status of each series: enough valid values, and a spread above zero."""
    stats = obs.groupBy("series").agg(F.count(F.lit(1)).alias("n_total"), F.count("v").alias("n_valid"),
                                      F.min("v").alias("lo"), F.max("v").alias("hi"))
    return stats.select("series", "n_total", "n_valid", (
        F.when(F.col("n_valid") < min_samples, "insufficient_data")
        .when((F.col("n_valid") > 1) & (F.col("lo") == F.col("hi")), "no_variance")
        .otherwise("valid")).alias("status"))


def pair_gate(obs: DataFrame, target: str, min_samples: int = vocab.MIN_CORRELATION_SAMPLES) -> DataFrame:
    """Gate of every candidate against the target on their common valid dates."""
    valid = obs.filter(F.col("v").isNotNull())
    t = valid.filter(F.col("series") == target).select("d", F.col("v").alias("tv"))
    pairs = valid.filter(F.col("series") != target).join(t, "d", "left")
    both = F.col("tv").isNotNull()
    lo_hi = [F.min(F.when(both, F.col("v"))), F.max(F.when(both, F.col("v"))), F.min("tv"), F.max("tv")]
    stats = pairs.groupBy("series").agg(F.count("tv").alias("n_common"),
                                        *[e.alias(n) for e, n in zip(lo_hi, ("lo", "hi", "tlo", "thi"))])
    flat = (F.col("lo") == F.col("hi")) | (F.col("tlo") == F.col("thi"))
    return stats.select("series", "n_common", (
        F.when(F.col("n_common") == 0, "no_common_data")
        .when(F.col("n_common") < min_samples, "insufficient_data")
        .when((F.col("n_common") > 1) & flat, "no_variance").otherwise("valid")).alias("status"))


def weight_coverage(observed: DataFrame, weights: DataFrame) -> DataFrame:
    """Every indicator of either side and where it is present."""
    left = observed.select("indicator").distinct().withColumn("_o", F.lit(True))
    right = weights.select("indicator").distinct().withColumn("_w", F.lit(True))
    both = left.join(right, "indicator", "full_outer")
    return both.select("indicator", F.when(F.col("_w").isNull(), "without_weight")
                       .when(F.col("_o").isNull(), "without_data").otherwise("matched").alias("status"))


def industry_conflicts(dictionary: DataFrame, sheet_map: DataFrame) -> DataFrame:
    """Variables whose dictionary industry differs from, or lacks against, the sheet's."""
    d = dictionary.select(text.normalize_text(F.col("variable")).alias("variable"),
                          F.col("industry").alias("dictionary_industry"))
    s = sheet_map.select(text.normalize_text(F.col("variable")).alias("variable"),
                         F.col("industry").alias("sheet_industry"))
    joined = s.join(d, "variable", "left")
    return joined.select("variable", "sheet_industry", "dictionary_industry", (
        F.when(F.col("dictionary_industry").isNull(), "undefined")
        .when(F.col("dictionary_industry") != F.col("sheet_industry"), "conflict")
        ).alias("problem")).filter(F.col("problem").isNotNull())


def parameter_errors(target: str | None, start: str | None, end: str | None,
                     target_freq: str = "W-FRI") -> list[str]:
    """Problems with the arguments of a panel preparation."""
    errors = []
    if not (target or "").strip():
        errors.append("target variable is empty")
    if start and end and start >= end:
        errors.append("start date must precede end date")
    if not target_freq.upper().endswith("-FRI"):
        errors.append("only week-ending-Friday panels are supported")
    return errors


def profile(df: DataFrame) -> DataFrame:
    """Null count and share plus type class of each column, in one scan."""
    def kind(t: str) -> str:
        if t in ("date", "timestamp", "timestamp_ntz"):
            return "datetime"
        return "numeric" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "text"

    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = one.unpivot(["_n"], df.columns, "column_name", "n_valid")
    kind_of = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kind(kinds[c]))])
    return long.select("column_name", F.element_at(kind_of, F.col("column_name")).alias("kind"),
                       F.col("_n").alias("n_rows"), (F.col("_n") - F.col("n_valid")).alias("n_null"),
                       F.try_divide((F.col("_n") - F.col("n_valid")) * 100.0, F.col("_n")).alias("null_pct"))
