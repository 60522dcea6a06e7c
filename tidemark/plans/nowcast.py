"""Training: select variables, choose factors, fit, forecast, evaluate, save."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation, factor, selection
from tidemark.operators.selection import Setting


def train(panel: DataFrame, s: Setting, variables: list[str], method: str | None = None, factor_rule: str = "fixed",
          observation_end: str | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """Every model table of one target.

    ``method`` is ``backward``, ``stepwise`` or None; ``factor_rule`` fixes the
    number of factors or derives it from the component table."""
    chosen, history = sorted(v for v in variables if v != s.target), None
    if method:
        chosen, history = {"backward": selection.backward, "stepwise": selection.stepwise}[method](panel, variables, s)
    models = panel.filter(F.col("series").isin(chosen)).select(
        F.lit(s.target).alias("model_id"), "d", F.col("series").alias("variable"), "v")
    components = factor.spectrum(models, s.train_start, s.train_end)
    if factor_rule != "fixed":
        number = factor.choose_factors(components, factor_rule).first()
        if number["problem"]:
            raise ValueError(number["problem"])
        s = replace(s, k=number["k"])
    target = panel.filter(F.col("series") == s.target).select("d", "v")
    out = factor.fit(models, s.k, s.train_start, s.train_end, s.max_iter, s.tolerance, s.order)
    nowcast, loading = factor.forecast(out["factors"], target, s.k, s.train_start, s.train_end)
    per_model = target.withColumn("model_id", F.lit(s.target))
    out |= {"nowcast": nowcast, "target_loading": loading, "components": components,
            "metrics": evaluation.evaluate_periods(nowcast, per_model, s.train_end, s.validation_start, s.validation_end, observation_end, s.mode),
            "aligned": evaluation.aligned_table([nowcast], per_model), "target_statistics": evaluation.target_statistics(per_model)}
    if history is not None:
        out["history"] = history
    if path:
        factor.save_model(out, path)
    return out
