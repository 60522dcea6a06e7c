"""Scans: wide sheets to long observations, dictionaries, weights, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions import calendar as cal
from tidemark.functions import numeric, text


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Header CSV with every column as text.

    Without an encoding each file has its own: UTF-8, unless a line of it fails
    to decode, which means a GBK family file.  Files of one encoding are one
    scan, and columns that one of the two lacks are null there.  GBK needs the
    session setting ``spark.sql.legacy.javaCharsets``, see ``tidemark.session``."""
    if encoding is None:
        broken = [r[0] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.is_valid_utf8("value").alias("ok"))
                  .groupBy("f").agg(F.bool_and("ok").alias("ok")).filter("not ok").select("f").collect()]
        if broken:
            names = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct()
            good = [r[0] for r in names.filter(~F.col("f").isin(broken)).collect()]
            parts = [read_csv(spark, files, code) for files, code in ((good, "UTF-8"), (broken, "GB18030")) if files]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        encoding = "UTF-8"
    df = spark.read.csv(path, header=True, encoding=encoding)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("\ufeff"))


def read_wide(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """A date-indexed wide table, by suffix: Parquet keeps types, CSV is text."""
    probe = path if isinstance(path, str) else path[0]
    if probe.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    return read_csv(spark, path, encoding)


#: Values of the first column that are tried as dates.
TRIED = 5


def time_column(df: DataFrame) -> str | None:
    """The only date or timestamp column; none if there are several; without
    any, the first column if one of its first values reads as a date."""
    timed = [n for n, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    if timed or not df.columns:
        return timed[0] if len(timed) == 1 else None
    first = F.col(f"`{df.columns[0]}`")
    tried = df.select(first.cast("string").alias("t")).filter(F.col("t").isNotNull()).limit(TRIED)
    return None if tried.filter(parse_date(F.col("t")).isNotNull()).isEmpty() else df.columns[0]


def parse_date(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("date"), F.try_to_timestamp(raw.cast("string")).cast("date"))


def melt(df: DataFrame, time_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Wide to long text cells: ``(d_text, series, v_text, *keep)``."""
    time_col = time_col or time_column(df)
    if time_col is None:
        raise ValueError("no time column is plain; name one")
    values = [c for c in df.columns if c != time_col and c not in keep]
    wide = df.select(F.col(time_col).cast("string").alias("d_text"), *keep,
                     *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in values])
    return wide.unpivot(["d_text", *keep], [c.strip() for c in values], "series", "v_text")


def to_observations(cells: DataFrame) -> DataFrame:
    """Text cells to ``(series, d, v, ...)``; rows with a bad date are dropped,
    bad numbers become null so that gaps stay visible."""
    rest = [c for c in cells.columns if c not in ("series", "d_text", "v_text")]
    return (cells.select("series", parse_date(F.col("d_text")).alias("d"),
                         numeric.to_number(F.col("v_text")).alias("v"), *rest)
            .filter(F.col("d").isNotNull()))


def drop_empty(obs: DataFrame) -> DataFrame:
    """Without dates on which every series is null and without all-null series."""
    dates = obs.groupBy("d").agg(F.count("v").alias("n")).filter("n > 0").select("d")
    names = obs.groupBy("series").agg(F.count("v").alias("n")).filter("n > 0").select("series")
    return obs.join(dates, "d", "left_semi").join(names, "series", "left_semi")


def quality_gate(cells: DataFrame, target: str | None = None) -> DataFrame:
    """Parse ratios of each series and whether they pass the scan thresholds.

    One aggregation: share of parseable dates and, among those rows, share of
    parseable numbers; the target needs a higher share than predictors."""
    date = parse_date(F.col("d_text"))
    value = numeric.to_number(F.col("v_text"))
    floor = F.when(F.col("series") == F.lit(target), vocab.MIN_TARGET_RATIO).otherwise(
        vocab.MIN_PREDICTOR_RATIO)
    stats = cells.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(date.isNotNull().cast("double")).alias("date_ratio"),
        F.avg(F.when(date.isNotNull(), value.isNotNull().cast("double"))).alias("value_ratio"))
    return stats.withColumn("passed", (F.col("date_ratio") >= vocab.MIN_DATE_RATIO)
                            & (F.coalesce("value_ratio", F.lit(0.0)) >= floor))


def scan_sheet(cells: DataFrame, target: str | None = None) -> DataFrame:
    """Observations of the series that pass :func:`quality_gate`."""
    good = quality_gate(cells, target).filter("passed").select("series")
    return to_observations(cells).join(good, "series", "left_semi")


def read_sheets(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """One CSV per sheet, all scanned as one job per schema, tagged by file.

    Sheets differ in columns, so each header is melted on its own and the long
    results are united; ``src_pos`` orders sheets as given."""
    out = None
    for pos, path in enumerate(paths):
        raw = spark.read.csv(path, header=True, encoding=encoding)
        raw = raw.withColumn("source", F.col("_metadata.file_name")).withColumn("src_pos", F.lit(pos))
        cells = melt(raw, raw.columns[0], keep=("source", "src_pos"))
        out = cells if out is None else out.unionByName(cells)
    return out


def undefined_series(obs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Scanned series without a dictionary row; a strict scan wants none."""
    named = obs.select("series").distinct().withColumn("name_norm", text.normalize_text(F.col("series")))
    return named.join(dictionary.select("name_norm"), "name_norm", "left_anti").select("series")


def first_source(obs: DataFrame) -> DataFrame:
    """A series present in several sources keeps only the first source."""
    winner = obs.groupBy("series").agg(F.min_by("source", F.struct("src_pos", "source")).alias("source"))
    return obs.join(winner, ["series", "source"], "left_semi")


def route_by_frequency(obs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``freq`` from the dictionary; series outside it are dropped and a
    duplicate date keeps its last row."""
    freq = dictionary.select("name_norm", "freq").filter(F.col("freq").isNotNull())
    # Names are folded once per series, not once per observation.
    names = obs.select("series").distinct().withColumn("name_norm", text.normalize_text(F.col("series")))
    # Raw rows are reduced before the join, so a hot series is a short one there.
    last = obs.groupBy("series", "d").agg(F.max_by("v", "src_pos").alias("v"))
    return last.join(names.join(freq, "name_norm").select("series", "freq"), "series").select("series", "freq", "d", "v")


def indicator_dictionary(raw: DataFrame, order_col: str) -> DataFrame:
    """One row per normalised name, the last raw row winning.

    Expects ``name, type, industry, freq_text, unit, nature, predictor,
    target, lag_text``; the answer ``是`` marks predictors and targets."""
    rows = raw.filter(F.trim("name") != "").select(
        text.normalize_text(F.col("name")).alias("name_norm"), F.trim("name").alias("name"),
        F.coalesce("type", F.lit(vocab.UNCLASSIFIED)).alias("type"),
        F.coalesce("industry", F.lit(vocab.UNCLASSIFIED)).alias("industry"),
        text.frequency_code(F.col("freq_text")).alias("freq"), "unit", "nature",
        (F.trim("predictor") == "是").alias("is_predictor"),
        (F.trim("target") == "是").alias("is_target"),
        numeric.to_number(F.col("lag_text")).cast("int").alias("publication_lag_days"),
        F.col(order_col).alias("_pos"))
    last = rows.groupBy("name_norm").agg(F.max_by(F.struct(*rows.columns[1:-1]), "_pos").alias("r"))
    return last.select("name_norm", "r.*")


def scan_monthly(obs: DataFrame, zero_to_null: bool = False,
                 blank_early_months_of: str | None = None) -> DataFrame:
    """Month-start observations, the first row of each month kept.

    Zeros may become null; one named series may lose January and February."""
    monthly = (obs.filter(F.col("d").isNotNull())
               .groupBy("series", F.trunc("d", "MM").cast("date").alias("d"))
               .agg(F.min_by("v", "src_pos").alias("v")))
    if zero_to_null:
        monthly = monthly.withColumn("v", F.nullif("v", F.lit(0.0)))
    if blank_early_months_of is not None:
        early = (F.col("series") == blank_early_months_of) & F.month("d").isin(1, 2)
        monthly = monthly.withColumn("v", F.when(~early, F.col("v")))
    return monthly


def melt_weights(wide: DataFrame, prefix: str = "权重_") -> DataFrame:
    """``权重_YYYY`` columns to rows ``(indicator, ..., weight_year, weight)``."""
    years = [c for c in wide.columns if c.startswith(prefix)]
    ids = [c for c in wide.columns if c not in years]
    cast = wide.select(*ids, *[numeric.to_number(F.col(c)).alias(c) for c in years])
    return (cast.unpivot(ids, years, "_y", "weight")
            .withColumn("weight_year", F.regexp_replace("_y", prefix, "").cast("int")).drop("_y"))


def time_ranges(obs: DataFrame, sheet: str) -> DataFrame:
    """Range and row count per sheet plus the overall row (null sheet)."""
    return obs.rollup(sheet).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"),
                                 F.count(F.lit(1)).alias("n_rows"))


def stage(df: DataFrame, name: str, columns: Sequence[str] | None = None,
          start=None, end=None) -> DataFrame:
    """Register a named view, optionally of chosen columns and dates."""
    if start is not None:
        df = df.filter(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("d") <= F.lit(end).cast("date"))
    df = df.select(*columns) if columns else df
    df.createOrReplaceTempView(name)
    return df


def resolve_requested(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names to stored names: exact first, else folded; null when missing."""
    have = available.select(F.col("series").alias("match"),
                            text.normalize_variable(F.col("series")).alias("_norm"))
    folded = have.groupBy("_norm").agg(F.min("match").alias("folded"))
    return (requested.withColumn("_norm", text.normalize_variable(F.col("requested")))
            .join(have.select(F.col("match").alias("exact")).distinct(),
                  F.col("requested") == F.col("exact"), "left")
            .join(folded, "_norm", "left")
            .select("requested", F.coalesce("exact", "folded").alias("series")))
