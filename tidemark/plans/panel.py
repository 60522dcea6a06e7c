"""Panel preparation: observations and dictionary to a weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import align, clean, stationarity, window
from tidemark.session import cut_lineage
from tidemark.sources import audit, scan


def prepare_panel(obs: DataFrame, dictionary: DataFrame, target: str, start: str, end: str, threshold: int = 10,
                  borrow: bool = True, align_frequencies: bool = True, zeros: str = "missing",
                  negatives: str = "none", shift_publication: bool = False, target_freq: str = "W-FRI") -> DataFrame:
    """Dense weekly panel ``(series, d, v)`` from raw ``(series, d, v, src_pos)``.

    Classify by frequency, apply zero and negative rules, shift to publication
    dates, align and gate per frequency, merge on the Friday spine and drop
    empty series, all partitioned by series.  The routed observations feed six
    frequency branches and the aligned ones both spine and values, so each is
    stored once instead of being computed per use.  Without alignment the
    original dates are kept and only the gap rule applies."""
    errors = audit.parameter_errors(target, start, end, target_freq)
    if errors:
        raise ValueError("; ".join(errors))
    routed = scan.route_by_frequency(obs, dictionary)
    ruled = routed.withColumn("v", clean.negative_rule(clean.zero_rule(F.col("v"), zeros), negatives))
    if shift_publication:
        ruled = window.shift_publication(ruled, dictionary)
    ruled = cut_lineage(ruled)
    if not align_frequencies:
        return align.drop_gappy(clean.between_dates(ruled.select("series", "d", "v"), start, end), threshold)
    aligned = cut_lineage(align.align_and_gate(ruled, threshold, start, end, borrow))
    panel = align.merge_panel([aligned.select("series", "d", "v")], start, end)
    alive = panel.groupBy("series").agg(F.count("v").alias("n")).filter("n > 0").select("series")
    return panel.join(alive, "series", "left_semi")


def panel_report(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Stationarity of every panel variable, problems first."""
    from tidemark.operators.rank import problem_variables_first
    return problem_variables_first(stationarity.test_stationarity(panel, alpha))
