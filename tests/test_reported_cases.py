"""Cases once answered wrongly without an error."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import factor, lagged, rank, window
from tidemark.sources import scan

D = dt.date


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "u.csv").write_text("日期,钢价\n2024-01-05,1\n", encoding="utf-8")
    (tmp_path / "g.csv").write_bytes("日期,煤价\n2024-01-05,3\n".encode("gbk"))
    wide = scan.read_wide(spark, [str(tmp_path / "u.csv"), str(tmp_path / "g.csv")])
    assert set(wide.columns) == {"日期", "钢价", "煤价"}
    got = {r["series"]: r["v"] for r in scan.to_observations(scan.melt(wide, "日期")).filter("v is not null").collect()}
    assert got == {"钢价": 1.0, "煤价": 3.0}


def test_names_fold_as_compatibility_forms(spark):
    names = ["①产量㎡", "ＡＢＣ：１", "ﬁne", "ｶﾞｽ", "価格", "K", "é", "é", "½", "㈱", "Ⅳ", "a b", "·—、。【】", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.normalize_variable(F.col("n"))).collect()]
    assert [g for g, n in zip(got, names) if n] == [unicodedata.normalize("NFKC", n).strip().lower() for n in names if n]
    dictionary = spark.createDataFrame([("1产量m2", "M")], "name_norm string, freq string")
    obs = spark.createDataFrame([("①产量㎡", D(2024, 1, 31), 1.0, 0), ("①产量㎡", D(2024, 1, 31), 2.0, 1)], "series string, d date, v double, src_pos int")
    assert [tuple(r) for r in scan.route_by_frequency(obs, dictionary).collect()] == [("①产量㎡", "M", D(2024, 1, 31), 2.0)]


def test_chains_run_to_their_end(spark, series):
    obs = series({"a": {f"2024-0{m}-01": float(m ** 5) for m in range(1, 9)}, "b": {f"2024-0{m}-01": float(m) for m in range(1, 9)}})
    rows = [("a", "none", ["diff_1"] * 5), ("b", "none", ["none", "log"])]
    config = spark.createDataFrame(rows, "variable string, zero_method string, ops array<string>")
    got = {r["d"]: r["v"] for r in window.transform(obs.select("series", "d", "v"), config, "MS").filter("series = 'a'").collect()}
    assert [got[D(2024, m, 1)] for m in range(1, 9)] == [None] * 5 + [120.0] * 3
    long = spark.createDataFrame([("a", "none", ["diff_1"] * 25)], "variable string, zero_method string, ops array<string>")
    with pytest.raises(ValueError, match="25"):
        window.transform(obs, long, "MS")


def test_unmet_factor_rules_have_a_problem(spark):
    rows = [("m", i + 1, e, r, c, 4) for i, (e, r, c) in enumerate(((0.9, 0.6, 0.6), (0.6, 0.3, 0.9), (0.2, 0.1, 1.0)))]
    table = spark.createDataFrame(rows, "model_id string, component int, eigenvalue double, ratio double, cumulative double, n_variables long")
    one = lambda *a, **b: tuple(factor.choose_factors(table, *a, **b).select("k", F.col("problem").isNotNull()).first())
    assert one("fixed", fixed=9) == (None, True) and one("fixed", fixed=3) == (3, False)
    assert one("cumulative", threshold=1.5) == (None, True) and one("cumulative", threshold=0.9) == (2, False)
    assert one("elbow", elbow=-1.0) == (None, True) and one("elbow", elbow=-0.25) == (1, False)
    assert one("kaiser") == (None, True) and one("kaiser", kaiser=0.5) == (2, False)


def test_time_column_is_tested(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert scan.time_column(frame([("2024-01-05", 1.0)], "a string, b double")) == "a"
    assert scan.time_column(frame([("x", 1.0)], "a string, b double")) is None
    assert scan.time_column(frame([(D(2024, 1, 1), D(2024, 1, 2))], "a date, b date")) is None
    with pytest.raises(ValueError, match="time column"):
        scan.melt(frame([("x", 1.0)], "a string, b double"))


def test_sheet_names_of_many_parts(spark):
    name = "_".join(["钢铁", "周度", *map(str, range(1500))])
    got = spark.createDataFrame([(name,)], "s string").select(text.sheet_info(F.col("s"), "t")["source"]).first()[0]
    assert got.endswith("_1499")


def test_raw_target_rows_do_not_multiply_pairs(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    rows = [("t", d, float(i % 7)) for i, d in enumerate(days)] + [("c", d, float(i % 5)) for i, d in enumerate(days)]
    obs = spark.createDataFrame(rows, "series string, d date, v double")
    twice = obs.unionByName(obs.filter("series = 't'"))
    key = lambda df: {(r["lag"]): r["correlation"] for r in lagged.lagged_correlation(df, "t", 3).collect()}
    assert key(obs) == key(twice)


def test_a_hot_key_in_a_narrow_range_is_split(spark):
    rows = [("hot", 1.0 + i * 1e-9) for i in range(9000)] + [(f"k{i % 10}", i * 1000.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    share = rank._bucketed(counts, ["k"], 64).groupBy("k", "_b").count().agg(F.max("count")).first()[0]
    assert share <= 9000 // 32
    got = {(r["k"], r["v"]): r["rank"] for r in rank.rank_descending(df, ["k"], F.col("v")).collect()}
    ordered = sorted((v for k, v in rows if k == "hot"), reverse=True)
    assert all(got["hot", v] == i + 1 for i, v in enumerate(ordered))
