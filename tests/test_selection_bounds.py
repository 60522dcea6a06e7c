
import datetime as dt

import numpy as np
import pytest

from tidemark.catalogue import QUERIES, factors
from tidemark.operators import selection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stepwise", "backward"])
def test_selections_see_every_variable_to_the_default_bound(spark, monkeypatch, name):
    seen = []

    def spy(panel, names, s):
        seen.append((set(names), s.max_iter))
        return names, selection._history(panel, [])

    monkeypatch.setattr(selection, name, spy)
    QUERIES[f"{name}_selection"](spark, SF)
    rows = factors._panel(spark, SF).select("model_id", "variable").distinct().collect()
    assert [names for names, _ in seen] == [{r.variable for r in rows if r.model_id == m} for m in ("F", "O")]
    assert [bound for _, bound in seen] == [30, 30] and factors.SETTING.max_iter == selection.Setting("t", 1, "", "", "", "").max_iter


def test_each_set_has_its_own_rounds(spark):
    rng = np.random.default_rng(3)
    driver = np.cumsum(rng.normal(size=40))
    data = {"target": driver, "a": driver + 0.05 * rng.normal(size=40), "b": driver + rng.normal(size=40)}
    days = [dt.date(2020, 1, 3) + dt.timedelta(days=7 * t) for t in range(40)]
    panel = spark.createDataFrame([(n, days[t], float(v[t])) for n, v in data.items() for t in range(40)], "series string, d date, v double")
    s = selection.Setting("target", 1, *[days[i].isoformat() for i in (0, 29, 30, 39)], max_iter=3, tolerance=1e9, mode="current_month")
    scored = selection.change_one(panel, ["a", "b"], ["a", "b"], s, "remove").collect()
    assert [(r.rounds, r.converged) for r in scored] == [(2, True)] * 2  # any second likelihood is near enough
    assert {"rounds", "converged"} <= set(selection._history(panel, []).columns)
