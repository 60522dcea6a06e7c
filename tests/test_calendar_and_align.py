"""Hand-made edges of calendars, borrowing, gaps, as-of joins and weights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import align, contribution, window

D = dt.date


def brute_friday(d, period, dekad=False):
    wd = d.weekday()
    shift = -3 if dekad and wd == 0 else 4 - wd
    target = d + dt.timedelta(days=shift)
    key = {"month": lambda x: (x.year, x.month), "quarter": lambda x: (x.year, (x.month - 1) // 3), "year": lambda x: x.year}[period]
    if key(target) == key(d):
        return target
    step = -1 if target > d else 1
    day = d
    while key(day + dt.timedelta(days=-step)) == key(d):
        day += dt.timedelta(days=-step)
    while day.weekday() != 4:
        day += dt.timedelta(days=step)
    return day


def test_fridays_match_brute_force(spark):
    days = [D(1994, 12, 25) + dt.timedelta(days=i) for i in range(2600)]
    c = F.col("d")
    rows = spark.createDataFrame([(x,) for x in days], "d date").select(
        c, *[cal.period_friday(c, p).alias(p) for p in ("month", "quarter", "year")], cal.dekad_friday(c).alias("dekad")).collect()
    for r in rows:
        for p in ("month", "quarter", "year"):
            assert r[p] == brute_friday(r["d"], p), (r["d"], p)
        assert r["dekad"] == brute_friday(r["d"], "month", dekad=True)


def test_new_year_weekends_clamp_forward(spark):
    c = F.col("d")
    rows = spark.createDataFrame([(D(2000, 1, 1),), (D(1995, 1, 1),)], "d date").select(cal.period_friday(c, "month").alias("f")).collect()
    assert [r["f"] for r in rows] == [D(2000, 1, 7), D(1995, 1, 6)]


def test_weekly_borrowing_copies_from_full_weeks_only(series):
    # Week ending 5 Jan is empty before a week with one value, 19 Jan before a
    # week with two, 2 Feb is the last window.
    obs = series({"a": {"2024-01-08": 1, "2024-01-22": 2, "2024-01-25": 3}})
    got = {r["d"]: (r["v"], r["borrowed_from"]) for r in align.align_weekly(obs, "2024-01-05", "2024-02-02").collect()}
    assert got[D(2024, 1, 5)] == (None, None)
    assert got[D(2024, 1, 12)] == (1.0, None)
    assert got[D(2024, 1, 19)] == (2.0, D(2024, 1, 22))
    assert got[D(2024, 1, 26)] == (3.0, None)
    assert got[D(2024, 2, 2)] == (None, None)


def test_moving_borrow_empties_the_donor(series):
    obs = series({"a": {"2024-01-10": None, "2024-01-12": 5, "2024-01-15": 6}})
    got = {r["d"]: r["v"] for r in align.borrow_move(obs, "K").collect()}
    assert got == {D(2024, 1, 10): 5.0, D(2024, 1, 12): None, D(2024, 1, 15): 6.0}
    # A window without any row cannot receive a value.
    lonely = series({"a": {"2024-01-12": 5, "2024-01-15": 6}})
    assert {r["d"]: r["v"] for r in align.borrow_move(lonely, "K").collect()} == {D(2024, 1, 12): 5.0, D(2024, 1, 15): 6.0}


def weeks(values):
    return {(D(2024, 1, 5) + dt.timedelta(days=7 * i)).isoformat(): v for i, v in enumerate(values)}


def test_gap_rule(series):
    obs = series({"lead": weeks([None, None, None, 1, 1]), "trail": weeks([1, 1, None, None, None]),
                  "tie": weeks([1, None, 1, None, 1]), "empty": weeks([None] * 5), "full": weeks([1] * 5)})
    report = {r["series"]: r for r in window.gap_report(obs).collect()}
    assert {k: r["longest_gap"] for k, r in report.items()} == {"lead": 0, "trail": 3, "tie": 1, "empty": 5, "full": 0}
    assert report["tie"]["gap_start"] == D(2024, 1, 12)
    for threshold in (1, 2, 3, 5):
        kept = {r["series"] for r in window.drop_gappy(obs, threshold).select("series").distinct().collect()}
        assert kept == {k for k, r in report.items() if r["longest_gap"] < threshold}


def test_gap_rule_inside_a_date_range(series):
    obs = series({"a": weeks([1, None, None, None, 1]), "b": weeks([1, 1, 1, None, None])})
    kept = lambda t: {r["series"] for r in window.drop_gappy(obs, t, "2024-01-19", "2024-02-02").select("series").distinct().collect()}
    report = {r["series"]: r["longest_gap"] for r in window.gap_report(obs, "2024-01-19", "2024-02-02").collect()}
    assert report == {"a": 0, "b": 2}
    assert kept(2) == {"a"}


def test_nearest_asof_tolerance_and_ties(series):
    obs = series({"edge": {"2023-04-15": 10, "2024-05-15": 11}, "far": {"2023-04-14": 10, "2024-05-15": 11},
                  "tie": {"2023-05-10": 10, "2023-05-20": 20, "2024-05-15": 40}, "hole": {"2023-05-14": None, "2023-05-01": 5, "2024-05-15": 10}})
    got = {r["series"]: r["v"] for r in align.year_on_year(obs).filter("year(d) = 2024").collect()}
    assert got["edge"] == pytest.approx(10.0)
    assert got["far"] is None
    assert got["tie"] == pytest.approx(100.0)
    assert got["hole"] is None


def test_effective_weights(spark):
    obs = spark.createDataFrame([("x", D(y, 3, 1), 1.0) for y in (2011, 2012, 2015, 2018, 2021)], "indicator string, d date, v double")
    w = spark.createDataFrame([("x", 2012, 0.1), ("x", 2015, None), ("x", 2018, 0.3)], "indicator string, weight_year int, weight double")
    got = {r["d"].year: r["weight"] for r in contribution.effective_weights(obs, w).collect()}
    assert got == {2011: 0.0, 2012: 0.1, 2015: 0.1, 2018: 0.3, 2021: 0.3}


def test_resample_empty_buckets(series):
    obs = series({"a": {"2024-01-15": 1, "2024-03-15": 2}})
    total = {r["d"]: r["v"] for r in align.resample(obs, "Monthly", "sum").collect()}
    assert total == {D(2024, 1, 31): 1.0, D(2024, 2, 29): 0.0, D(2024, 3, 31): 2.0}
    mean = {r["d"] for r in align.resample(obs, "Monthly", "mean").collect()}
    assert mean == {D(2024, 1, 31), D(2024, 3, 31)}


def test_interpolation_carries_the_end_and_leaves_the_start(series):
    obs = series({"a": weeks([None, 1, None, 3, None]), "b": weeks([1] * 5)})
    got = [r["v"] for r in align.align_series(obs, "outer", "interpolate").filter("series = 'a'").orderBy("d").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 3.0]


def test_results_do_not_depend_on_partitioning(spark, series):
    import random
    rnd = random.Random(1)
    obs = series({f"s{i}": {(D(2024, 1, 1) + dt.timedelta(days=j)).isoformat(): rnd.choice([None, rnd.random()]) for j in range(60)} for i in range(5)})

    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        shuffled = obs.repartition(parts, F.rand(3))
        return sorted(map(tuple, align.align_weekly(shuffled, "2024-01-05", "2024-02-23").collect()), key=str)
    one, eight = run(1), run(8)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert one == eight
