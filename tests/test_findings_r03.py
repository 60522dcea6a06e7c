"""Cases of the third round's findings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.catalogue import QUERIES
from tidemark.functions import text
from tidemark.operators import summary
from tidemark.sources import audit

D = dt.date


def test_small_negative_numbers_keep_their_sign_and_missing_ones_are_dashes(spark):
    """formatted_numbers."""
    values = [-0.047, -0.05, 0.047, 0.0, -1.25, 12.34, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(text.fixed_decimals(F.col("v"), 1)).collect()]
    assert got == ["-0.0", "-0.1", "0.0", "0.0", "-1.3", "12.3", "-", "-"]


ONE_EXCHANGE = [
    "borrow_move_dekad",  # F2
    "seasonal_profile_d",  # F3
    "gap_report",  # F6
    "time_series_audit_sparse",  # F7
    "align_weekly_borrow",  # F8
    "borrowing_log",  # F9
    "borrow_move_weekly",  # F11
]


@pytest.mark.parametrize("name", ONE_EXCHANGE)
def test_one_exchange_into_tasks_of_bounded_rows(spark, monkeypatch, capsys, name):
    """All work on a series follows one exchange, whose tasks grow in number and not in size."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(series#" in plan
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan


def test_profile_lists_all_periods_of_series_beyond_the_last(spark, series):
    """2020 has a week 53, 2022 has not; a series seen only there keeps its empty weeks."""
    obs = series({"a": {"2020-12-30": 5}, "b": {"2022-01-05": 2, "2021-01-06": 4, "2020-12-30": 9}})
    got = {}
    for r in summary.seasonal_profile(obs, "W", 2022).collect():
        got.setdefault(r["series"], {})[r["period"]] = (r["low"], r["high"], r["current"], r["previous"])
    empty = {w: (None, None, None, None) for w in range(1, 53)}
    assert got == {"a": empty, "b": empty | {1: (2.0, 4.0, 2.0, 4.0)}}


def test_audit_of_single_and_repeated_dates(spark, series):
    """one pass gives what two branches and a join gave."""
    obs = series({"one": {"2024-01-01": 1}, "gap": {"2024-01-01": None, "2024-01-08": 1, "2024-01-15": 2}})
    twice = obs.unionByName(obs.filter("series = 'gap' and d = '2024-01-08'"))
    got = {r["series"]: (r["n_rows"], r["n_duplicates"], r["frequency"], r["irregular"], r["last_date"]) for r in audit.time_series_audit(twice).collect()}
    assert got == {"one": (1, 0, "unknown", False, D(2024, 1, 1)), "gap": (4, 1, "weekly", True, D(2024, 1, 15))}


def test_names_are_folded_and_tightened_once(spark, capsys):
    """one expression per step gives what the marks one after the other give, once per row."""
    pieces = ["a", "B ", " :", ": ", "  ,  ", "（ ", " Ａ", "\t\n", " -  . ", "。 ", "  ", "é", " "]
    names = [x + y + z for x in pieces for y in pieces for z in pieces]

    def stepwise(name):
        c = name.translate({0xFF01 + i: 0x21 + i for i in range(94)}).strip(" \t\n")
        for mark in text.TIGHT_PUNCTUATION:
            c = c.replace(" " + mark, mark).replace(mark + " ", mark)
        c = " ".join(x for x in c.replace("\t", " ").replace("\n", " ").split(" ") if x)
        return c.lower() if any(x < "\x80" for x in c) else c

    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = df.select("n", text.normalize_text(F.col("n"), exact=False).alias("c"))
    assert {r["n"]: r["c"] for r in out.collect()} == {n: stepwise(n) for n in names}
    out.explain()
    plan = capsys.readouterr().out
    assert "replace(" not in plan.replace("regexp_replace(", "") and plan.count("translate(") == 1


def test_fits_read_the_lines_once(spark):
    """a panel is read many times, from its weekly sums and not from the lines."""
    from tidemark.catalogue.factors import _panel
    panel = _panel(spark, "/root/testdata/sf0.001")
    assert panel.count() > 0 and not any("lineitem" in f for f in panel.inputFiles())
