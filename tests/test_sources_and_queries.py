"""Readers, cleaning rules, sinks, and registered queries against their SQL."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import numeric, text
from tidemark.operators import clean, summary
from tidemark.plans.nowcast import train
from tidemark.operators.selection import Setting
from tidemark.sources import audit, scan, sinks

D = dt.date
SF = "/root/testdata/sf0.001"


def test_csv_sheets_in_two_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_text("日期,钢价,空列\n2024-01-05,\"1,200.5%\",\n2024-01-12,x,\nbad,7,\n", encoding="utf-8")
    (tmp_path / "g.csv").write_bytes("日期,煤价\n2024-01-05,3\n".encode("gbk"))
    wide = scan.read_wide(spark, str(tmp_path / "u.csv"))
    obs = scan.to_observations(scan.melt(wide, wide.columns[0]))
    got = {(r["series"], r["d"]): r["v"] for r in obs.collect()}
    assert got[("钢价", D(2024, 1, 5))] == 1200.5 and got[("钢价", D(2024, 1, 12))] is None
    assert {r["series"] for r in scan.drop_empty(obs).collect()} == {"钢价"}
    assert scan.read_wide(spark, str(tmp_path / "g.csv")).columns == ["日期", "煤价"]
    sheets = scan.read_sheets(spark, [str(tmp_path / "u.csv")])
    assert {r["source"] for r in sheets.collect()} == {"u.csv"}
    assert {r["series"]: r["passed"] for r in scan.quality_gate(scan.melt(wide, wide.columns[0]), "钢价").collect()} == {"钢价": True, "空列": False}
    assert scan.scan_sheet(scan.melt(wide, wide.columns[0])).select("series").distinct().count() == 1


def test_parquet_and_time_column(spark, tmp_path):
    path = str(tmp_path / "w.parquet")
    spark.createDataFrame([(1.0, D(2024, 1, 5))], "a double, day date").write.parquet(path)
    wide = scan.read_wide(spark, path)
    assert scan.time_column(wide) == "day"
    assert scan.to_observations(scan.melt(wide)).first()["v"] == 1.0


def test_value_rules(spark):
    v = F.col("v")
    df = spark.createDataFrame([(0.0,), (-0.0,), (1e-10,), (-2.0,), (None,), (float("nan"),)], "v double")
    rows = df.select(clean.zero_rule(v).alias("z"), clean.zero_rule(v, "adjust").alias("a"), clean.negative_rule(v, "missing").alias("n"),
                     clean.near_zero_to_null(v).alias("t"), numeric.no_nan(v).alias("k")).collect()
    assert [r["z"] for r in rows[:4]] == [None, None, 1e-10, -2.0]
    assert [r["a"] for r in rows[:2]] == [1.0, 1.0]
    assert rows[3]["n"] is None and rows[2]["t"] is None and rows[5]["k"] is None


def test_growth_rules(spark, series):
    obs = series({"p": {"2023-12-31": -2, "2024-01-31": 1}, "r": {"2023-12-31": 2, "2024-01-31": 1}, "z": {"2023-12-31": 0, "2024-01-31": 1}})
    dims = spark.createDataFrame([("p", "%", "价格", "x"), ("r", "%", "开工率", "x"), ("z", "吨", "", "x")], "name string, unit string, type string, industry string")
    monthly = {r["series"]: r["growth"] for r in summary.summarize(obs, "M", dims).collect()}
    assert monthly == {"p": 3.0, "r": -0.5, "z": None}
    weekly = series({"p": {"2024-01-05": -2, "2024-01-12": 1}})
    assert summary.summarize(weekly, "W").first()["growth"] == 1.5
    assert summary.summarize(series({"p": {"2024-01-05": -2, "2024-02-09": 1}}), "M").first()["growth"] == -1.5


@pytest.mark.parametrize("raw,want", [("  工业增加值  ", "工业增加值"), ("用电量: 电气机械  ", "用电量:电气机械"),
                                      ("GDP  Growth  Rate", "gdp growth rate"), ("ＧＤＰ（ 同比 ）", "gdp(同比)"), ("", ""), (None, "")])
def test_name_normalisation(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "n string")
    got = df.select(text.normalize_text(F.col("n")).alias("a"), text.normalize_text(F.col("n"), exact=True).alias("b")).first()
    assert tuple(got) == (want, want)


def test_industry_from_source(spark):
    df = spark.createDataFrame([("f.xlsx|钢铁_周度_Mysteel",), ("f|周度_PMI",), ("f|日度",), ("单名",)], "s string")
    assert [r[0] for r in df.select(text.industry_from_source(F.col("s"))).collect()] == ["钢铁", "PMI", "日度", "单名"]


def test_rules_survive_json_and_drop_unknown_keys(spark):
    stored = spark.createDataFrame([(1, '{"variable":"a","rule_type":"months","months":[1,2],"extra":5}')], "rule_id int, rule string")
    back = clean.rules_from_json(stored).first()
    assert back["months"] == [1, 2] and "extra" not in back.asDict()


def test_parameter_errors():
    assert audit.parameter_errors("y", "2020-01-01", "2021-01-01") == []
    assert len(audit.parameter_errors(" ", "2022-01-01", "2021-01-01", "MS")) == 3


def test_train_and_save(spark, tmp_path):
    import numpy as np
    rng = np.random.default_rng(0)
    fridays = [D(2020, 1, 3) + dt.timedelta(days=7 * i) for i in range(60)]
    base = np.cumsum(rng.normal(size=60))
    rows = [(n, fridays[t], float(base[t] + rng.normal() * s)) for n, s in (("y", 0.1), ("a", 0.2), ("b", 0.4), ("c", 1.0)) for t in range(60)]
    panel = spark.createDataFrame(rows, "series string, d date, v double")
    s = Setting("y", 1, fridays[0].isoformat(), fridays[39].isoformat(), fridays[40].isoformat(), fridays[52].isoformat(), max_iter=2)
    out = train(panel, s, ["a", "b", "c"], factor_rule="cumulative", observation_end=fridays[59].isoformat(), path=str(tmp_path / "model"))
    assert {r["period"] for r in out["metrics"].collect()} == {"training", "validation", "observation"}
    stored = spark.read.parquet(str(tmp_path / "model" / "loadings"))
    assert stored.count() == out["loadings"].count()
    log = sinks.processing_log(panel)
    sinks.write_prepared(panel, log, log.select("variable"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "panel")).count() == panel.count()


SAMPLE = ["summary_weekly", "scan_wide", "indicator_dictionary", "replace_by_rules", "clean_table", "time_series_audit_sparse", "friday_mapping",
          "merge_panel", "yoy_growth_sparse", "align_weekly_borrow", "borrow_move_dekad", "align_by_frequency", "resample_weekly_sum",
          "transform_chain", "gap_report", "trailing_means", "group_contributions", "contribution_ranks", "seasonal_profile_d", "sheet_info",
          "lagged_correlation", "lagged_divergence", "warp_radius", "metrics_by_period", "best_candidate", "target_forecast", "key_drivers"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDEMARK_ORACLE") == "all" else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, df.select(*cols).collect()), key=key)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
