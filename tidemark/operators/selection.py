"""Variable selection: every round evaluates all candidate sets in shared jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import correlation
from tidemark.operators import evaluation, factor, toggles
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Setting:
    """How candidate sets are fitted, scored and compared."""

    target: str
    k: int
    train_start: str
    train_end: str
    validation_start: str
    validation_end: str
    max_iter: int = 30
    tolerance: float = 1e-6
    mode: str = "next_month"
    training_weight: float = 0.5
    min_variables: int = 1
    rule: dict = field(default_factory=dict)
    order: int = 1


def evaluate_sets(panel: DataFrame, candidates: DataFrame, s: Setting) -> DataFrame:
    """Training and validation metrics, score, rounds and convergence of every candidate set.

    ``panel(series, d, v)`` holds target and predictors; ``candidates`` lists
    ``(candidate_id, variable)``.  All sets are models of one fit."""
    models = panel.join(candidates.withColumnRenamed("variable", "series"), "series").select(
        F.col("candidate_id").alias("model_id"), "d", F.col("series").alias("variable"), "v")
    target = panel.filter(F.col("series") == s.target).select("d", "v")
    fitted = factor.fit(models, s.k, s.train_start, s.train_end, s.max_iter, s.tolerance, s.order)
    log = fitted["log"].select(F.col("model_id").alias("candidate_id"), "rounds", "converged")
    return _scored(fitted["factors"], target, log, s)


def _scored(factors: DataFrame, target: DataFrame, log: DataFrame, s: Setting) -> DataFrame:
    """Metrics of the nowcast that each set's long factors give."""
    nowcast, _ = factor.forecast(factors, target, s.k, s.train_start, s.train_end)
    period = evaluation.assign_period(F.col("d"), s.train_end, s.validation_start, s.validation_end)
    split = nowcast.withColumn("period", period).filter(F.col("period").isin("training", "validation"))
    m = evaluation.metrics(split, target, s.mode)
    pick = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = m.groupBy(F.col("model_id").alias("candidate_id")).agg(
        pick("training", "rmse").alias("is_rmse"), pick("validation", "rmse").alias("oos_rmse"),
        pick("training", "win_rate").alias("is_win"), pick("validation", "win_rate").alias("oos_win"))
    return wide.join(log, "candidate_id").withColumn("score", evaluation.weighted_score(
        F.col("is_rmse"), F.col("oos_rmse"), F.col("is_win"), F.col("oos_win"), s.training_weight))


@dataclass
class Prepared:
    """A panel made ready for rounds: variable rows, and the target's own dates."""

    panel: toggles.Panel
    target: DataFrame


def prepare(panel: DataFrame, s: Setting) -> Prepared:
    """``panel(series, d, v)`` as variable rows, beside its target."""
    held = cut_lineage(panel.select(F.col("series").alias("variable"), "d", "v"))
    target = held.filter(F.col("variable") == s.target).select("d", "v")
    return Prepared(toggles.panel_rows(held.filter(F.col("variable") != s.target), s.train_start, s.train_end), target)


def evaluate_toggles(p: Prepared, base: list[str], toggled: dict[str, str | None], s: Setting) -> DataFrame:
    """``evaluate_sets`` of sets that each differ from ``base`` by one variable."""
    fitted = cut_lineage(toggles.fit_sets(p.panel, base, toggled, toggles.Fit(s.k, s.order, s.max_iter, s.tolerance)))
    log = fitted.groupBy("candidate_id").agg(F.first("rounds").alias("rounds"), F.first("converged").alias("converged"))
    return _scored(factor.scores(fitted.withColumnRenamed("candidate_id", "model_id"), s.k), p.target, log, s)


def change_one(panel: DataFrame | Prepared, current: list[str], pool: list[str], s: Setting, operation: str) -> DataFrame:
    """Score every set made by adding or removing one variable of ``pool``.

    Sets with no more variables than factors are not evaluated."""
    size = len(current) + (1 if operation == "add" else -1)
    if not pool or size < 1 or s.k >= size + 1:
        raise ValueError("no candidate set has more variables than factors")
    p = panel if isinstance(panel, Prepared) else prepare(panel, s)
    return evaluate_toggles(p, current, {v: v for v in pool}, s)


def _best(scored: DataFrame, s: Setting, incumbent: tuple | None):
    """Name of a round's winner, its score with rounds and convergence of its fit,
    and whether it beats the incumbent: one row reaches the driver."""
    scored = cut_lineage(scored)
    w = evaluation.best_candidate(scored.withColumn("_g", F.lit(1)), ["_g"], **s.rule)
    mine = F.struct(*[F.lit(x).cast("double").alias(n) for n, x in zip(("win_rate", "rmse"), incumbent or (None, None))])
    row = w.join(scored.select("candidate_id", "rounds", "converged"), "candidate_id", "left").select("candidate_id", "win_rate", "rmse", "rounds", "converged", evaluation.compare_scores(
        F.struct("win_rate", "rmse"), mine, **s.rule).alias("verdict")).first()
    return row["candidate_id"], (row["win_rate"], row["rmse"], row["rounds"], row["converged"]), row["verdict"]


def _history(panel: DataFrame, rows: list[tuple]) -> DataFrame:
    return panel.sparkSession.createDataFrame(
        rows, "step int, action string, variable string, n_variables int, win_rate double, rmse double, rounds int, converged boolean")


def backward(panel: DataFrame, variables: list[str], s: Setting) -> tuple[list[str], DataFrame]:
    """Drop the variable whose loss hurts least until the comparison says worse."""
    current = sorted(v for v in variables if v != s.target)
    p = prepare(panel, s)
    _, score, _ = _best(evaluate_toggles(p, current, {"all": None}, s), s, None)
    rows = [(0, "baseline", None, len(current), *score)]
    while len(current) > max(s.min_variables, s.k):
        name, new, verdict = _best(change_one(p, current, current, s, "remove"), s, score)
        if name is None or verdict < 0:
            break
        current, score = [v for v in current if v != name], new
        rows.append((len(rows), "remove", name, len(current), *score))
    return current, _history(panel, rows)


def seed_by_correlation(panel: DataFrame, target: str, n: int) -> list[str]:
    """The ``n`` variables most correlated with the target, in absolute terms,
    counting those with at most ten common dates as zero."""
    x = panel.filter((F.col("series") == target) & F.col("v").isNotNull()).select("d", F.col("v").alias("x"))
    pairs = panel.filter((F.col("series") != target) & F.col("v").isNotNull()).join(x, "d", "left")
    strength = F.when(F.count("x") > 10, F.abs(correlation(F.col("x"), F.col("v"))))
    ranked = pairs.groupBy("series").agg(F.coalesce(strength, F.lit(0.0)).alias("c"))
    return [r["series"] for r in ranked.orderBy(F.col("c").desc(), "series").limit(n).collect()]


def stepwise(panel: DataFrame, variables: list[str], s: Setting) -> tuple[list[str], DataFrame]:
    """Add the best variable, then remove any whose loss improves the score.

    Starts from the best single variable for one factor, else from the most
    correlated ones.  Every acceptance uses the tolerance comparison."""
    pool = sorted(v for v in variables if v != s.target)
    panel = cut_lineage(panel)
    p = prepare(panel, s)
    if s.k == 1:
        name, score, _ = _best(change_one(p, [], pool, s, "add"), s, None)
        current = [name] if name else []
    else:
        current = seed_by_correlation(panel.filter(F.col("series").isin([s.target, *pool])), s.target, s.k + 1)
        _, score, _ = _best(evaluate_toggles(p, current, {"seed": None}, s), s, None)
    rows = [(0, "init", ",".join(current), len(current), *score)]
    tried = True
    while tried:
        tried = False
        rest = [v for v in pool if v not in current]
        if rest:
            name, new, verdict = _best(change_one(p, current, rest, s, "add"), s, score)
            if name is not None and verdict > 0:
                current, score, tried = [*current, name], new, True
                rows.append((len(rows), "add", name, len(current), *score))
        while tried and len(current) > max(s.min_variables, s.k):
            name, new, verdict = _best(change_one(p, current, current, s, "remove"), s, score)
            if name is None or verdict <= 0:
                break
            current, score = [v for v in current if v != name], new
            rows.append((len(rows), "remove", name, len(current), *score))
    return current, _history(panel, rows)
