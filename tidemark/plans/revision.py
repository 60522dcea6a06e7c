"""News analysis: model tables and observations to attributed revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import news, window
from tidemark.session import cut_lineage


def analyse(observed: DataFrame, model: dict[str, DataFrame], target: str, industries: DataFrame | None = None,
            month: str | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """Every table of the revision analysis, for one month or for all.

    ``model`` holds ``loadings, predicted, gains, target_loading, nowcast`` as
    written by training."""
    rel = news.releases(observed, model["loadings"], model["predicted"], target, month)
    # Every table below starts from the impacts, so they are stored once.
    imp = cut_lineage(news.impacts(rel, model["gains"], model["target_loading"]))
    raw = news.contributions(imp)
    contrib, info = news.normalize(raw, model["nowcast"])
    if industries is not None:
        contrib = news.with_industry(contrib, industries)
    out = {"contributions": contrib, "normalization": info, "path": window.running_impact(raw, news.baselines(imp, model["nowcast"])),
           "variables": news.variable_totals(contrib), "ranking": news.rank_variables(contrib), "drivers": news.key_drivers(contrib),
           "split": news.sign_split(contrib), "flow": news.data_flow(contrib, model["nowcast"]), "by_date": news.date_summary(contrib)}
    if industries is not None:
        totals = news.industry_totals(contrib)
        out |= {"industries": totals, "industry_dates": news.industry_by_date(contrib), "industry_ranking": news.industry_ranking(totals)}
    if path:
        news.write_analysis(contrib, out["ranking"], info, path)
    return out
