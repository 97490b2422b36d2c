import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import periods, scalars
from quarrylens.operators import scoring, timeseries
from quarrylens.sources import readers

# A worked example of one metric vector, category by category.
G1 = {
    "Price-to-Earnings": 28.0, "Price-to-Book": 12.0, "EV-to-EBITDA": 20.0, "EV-to-Sales": 7.0, "Price-to-Free-Cash-Flow": 30.0, "Gross Margin": 0.45, "Operating Margin": 0.30, "Net Profit Margin": 0.25, "Return on Equity": 1.5,
    "Current Ratio": 1.1, "Quick Ratio": 0.9, "Cash Ratio": 0.25, "Asset Turnover Ratio": 1.2, "Inventory Turnover Ratio": float("nan"), "Debt-to-Equity Ratio": 1.8, "Debt-to-Assets Ratio": 0.32, "Cash Conversion Efficiency": 1.2, "CAPEX Coverage Ratio": 9.0,
}
LONG = "company string, period string, metric string, value double"


def test_scores_of_the_worked_example(spark):
    df = spark.createDataFrame([("A", "2024Q1", k, v) for k, v in G1.items()], LONG)
    got = {r.category: (r.score, r.risk) for r in scoring.scores_without_peers(df).collect()}
    assert got == {"Valuation": (53.95, 46.05), "Profitability": (30.0, 70.0), "Liquidity": (60.02, 39.98), "Efficiency": (50.0, 50.0), "Leverage": (50.0, 50.0), "Cash Flow": (50.0, 50.0)}


def test_missing_categories_and_one_exchange(spark):
    df = spark.createDataFrame([("A", "2024Q1", "Gross Margin", 0.5), ("A", "2024Q1", "Quick Ratio", float("inf")), ("A", "2024Q1", "Cash Ratio", None), ("A", "2024Q1", None, 1.0)], LONG)
    s = scoring.scores_without_peers(df)
    got = {r.category: r.risk for r in scoring.with_gaps(s).collect()}
    assert len(got) == 6 and got["Profitability"] == 50.0 and got["Liquidity"] is None
    assert s._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_min_metrics_and_scale(spark):
    df = spark.createDataFrame([("A", "p", "Gross Margin", 0.5), ("A", "p", "Return on Equity", 0.1), ("A", "p", "Cash Ratio", 1.0)], LONG)
    got = {r.category: r.risk for r in scoring.scores_without_peers(df, least=2, scale=10.0).collect()}
    assert got == {"Profitability": 95.0, "Liquidity": None}


def test_peers(spark):
    peers = spark.createDataFrame([("p", "Quick Ratio", float(v)) for v in (1, 2, 2, 3, 10)], "period string, metric string, value double")
    for value, pct, mm, cdf in ((2.0, 40.0, 11.11, 31.19), (10.0, 80.0, 96.89, None), (0.0, 20.0, 0.44, None), (3.0, 70.0, 22.22, 42.7)):
        one = spark.createDataFrame([("A", "p", "Quick Ratio", value)], LONG)
        wide = one.unionByName(spark.createDataFrame([("A", "p", "Gross Margin", 0.4)], LONG))
        get = lambda m: {r.category: r.score for r in scoring.scores_with_peers(wide, peers, m).collect()}
        assert get("percentile") == {"Liquidity": pct, "Profitability": 40.0}  # without peers: the adjusted value itself
        assert get("minmax") == {"Liquidity": mm, "Profitability": 40.0}
        z = get("zscore")
        assert cdf is None or z["Liquidity"] == cdf
        assert z["Profitability"] == round(50 * (1 + math.erf(0.4 / math.sqrt(2))), 2)


def test_no_peer_at_all_falls_back_to_the_category(spark):
    peers = spark.createDataFrame([("other", "Quick Ratio", 1.0)], "period string, metric string, value double")
    df = spark.createDataFrame([("A", "p", "Current Ratio", 1.0), ("A", "p", "Quick Ratio", 0.5), ("A", "p", "Gross Margin", 0.3), ("B", "other", "Quick Ratio", 1.0), ("B", "other", "Gross Margin", 0.3)], LONG)
    got = {(r.company, r.category): r.score for r in scoring.scores_with_peers(df, peers).collect()}
    assert got == {("A", "Liquidity"): 50.0, ("A", "Profitability"): 50.0, ("B", "Liquidity"): 50.0, ("B", "Profitability"): 30.0}
    assert scoring.scores_with_peers(df.filter("false"), peers).count() == 0


def test_rank_probability_and_last_category(spark):
    df = spark.createDataFrame([("A", "p", m, v) for m, v in (("Current Ratio", 3.0), ("Quick Ratio", 1.0), ("Cash Ratio", 2.0), ("Gross Margin", 0.3))], LONG)
    none = spark.createDataFrame([], "period string, metric string, value double")
    got = {r.category: r.score for r in scoring.scores_with_peers(df, none, "zscore", probability="rank").collect()}
    assert got == {"Liquidity": 50.0, "Profitability": 50.0}
    twice = spark.createDataFrame([("one", 1, "Gross Margin"), ("one", 1, "Current Ratio"), ("two", 2, "Current Ratio"), ("two", 2, "Quick Ratio"), ("two", 2, "Return on Equity")], "category string, cat_ord int, metric string")
    rows = spark.createDataFrame([("A", "p", "Gross Margin", 0.0), ("A", "p", "Current Ratio", 0.5), ("A", "p", "Quick Ratio", 0.0), ("A", "p", "Return on Equity", 1.0)], LONG)
    got = {r.category: r.score for r in scoring.scores_without_peers(rows, groups=twice).collect()}
    assert got == {"one": 25.0, "two": 50.0}  # the second category's 0.5 counts in both


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        scoring.scores_with_peers(spark.createDataFrame([], LONG), method="rank")


def test_direction(spark):
    names = ["EV-to-Sales", "Return on Equity", "CAPEX Coverage Ratio", "Debt-to-Assets Ratio", "Earnings per share", "Quick Ratio", "Price-to-Income"]
    df = spark.createDataFrame([(n,) for n in names], "metric string").select("metric", scoring.higher_is_better(F.col("metric")).alias("g"), scoring.higher_is_better(F.col("metric"), {"Quick Ratio": False}).alias("o"))
    assert [r.g for r in df.collect()] == [False, True, False, False, True, True, False]
    assert [r.o for r in df.collect()][5] is False


def test_period_codes(spark):
    df = spark.createDataFrame([("Q3_2024",), ("2024",), ("FY_2024",), ("2024Q3",), ("x",), (None,), ("Q5_2024",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(periods.to_code(p), periods.sort_key(p), periods.start_date(p)).collect()]
    assert got == [("2024Q3", 202403, dt.date(2024, 7, 1)), ("2024", 202499, dt.date(2024, 1, 1)), ("2024", 202499, dt.date(2024, 1, 1)), ("2024Q3", 202403, dt.date(2024, 7, 1)), ("x", None, None), (None, None, None), ("2024Q5", 202405, None)]


def test_period_labels(spark):
    df = spark.createDataFrame([([2023, 2024], ["Q1", "Q2"]), ([2023, 2024], []), ([], ["Q1"]), (None, None)], "y array<int>, q array<string>")
    got = [r[0] for r in df.select(periods.labels(F.col("y"), F.col("q"))).collect()]
    assert got == [["Q1_2023", "Q2_2023", "Q1_2024", "Q2_2024"], ["FY_2023", "FY_2024"], [], []]


def test_finite(spark):
    df = spark.createDataFrame([("1",), ("Infinity",), ("-Infinity",), ("NaN",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(scalars.finite(F.col("v"))).collect()] == [1.0, None, None, None, None, None]


def test_display(spark):
    df = spark.createDataFrame([(0.456,), (45.6,), (250.0,), (-3.0,), (None,)], "v double")
    got = [tuple(r) for r in df.select(scalars.percent_display(F.col("v")), scalars.two_decimals(F.col("v"))).collect()]
    assert got == [(46.0, "0.46"), (46.0, "45.60"), (100.0, "250.00"), (0.0, "-3.00"), (None, "--")]


STOCK = "timeframe string, date date, company string, variable string, value double"


def test_chart(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("q", d, "A", "Close", 1.0), ("q", d, "A", "Open", float("nan")), ("q", dt.date(2023, 1, 1), "A", "Close", 3.0), ("q", d, "B", "Close", 9.0)], STOCK)
    c = timeseries.chart(df, "A", ["Open", "Nope", "Close"])
    assert c.columns == ["date", "Open", "Close"]
    assert [tuple(r) for r in c.collect()] == [("2023-01-01", None, 3.0), ("2024-01-01", None, 1.0)]
    assert timeseries.chart(df, "A", ["Nope"]).count() == 0
    assert timeseries.chart(spark.createDataFrame([], STOCK), "A", ["Close"]).count() == 0


def test_candles_only_for_all_four(spark):
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("q", d, "A", v, float(i)) for i, v in enumerate(("Open", "High", "Low", "Close"))], STOCK)
    (r,) = timeseries.candles(df, "A", ["Low", "High", "Open", "Close"]).collect()
    assert (r.x, r.name, r.y) == (1704067200000, "candles", [0.0, 1.0, 2.0, 3.0])
    assert {r.name for r in timeseries.candles(df, "A", ["Low", "Close"]).collect()} == {"Low", "Close"}


RATIO = "timeframe string, company string, metric string, period string, value double"


def test_ratio_table_reindex(spark):
    df = spark.createDataFrame([("q", "A", "a", "2024Q1", 1.0), ("q", "A", "b", "2024Q2", float("inf"))], RATIO)
    t = timeseries.ratio_table(df, "A", ["b", "zz"])
    assert t.columns == ["metric", "2024Q1", "2024Q2"] and [tuple(r) for r in t.collect()] == [("b", None, None), ("zz", None, None)]
    assert [r.metric for r in timeseries.ratio_table(df, "A", []).collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        timeseries.ratio_table(df, "Z", must_exist=True)
    with pytest.raises(KeyError):
        timeseries.point(df, "A", "Q3_1999")
    assert timeseries.at_period(df, "A", "Q1_2024").count() == 1 and timeseries.at_period(df, "A", "2024").count() == 0


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    readers.write_long(spark.createDataFrame([("quarterly", "A", "a", "2024Q1", 1.0), ("yearly", "A", "a", "2024", 1.0)], RATIO), path)
    df = timeseries.at_period(readers.read_long(spark, path, "ratios", "quarterly"), "A", "Q1_2024")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(timeframe" in plan and "EqualTo(company,A)" in plan and "EqualTo(period,2024Q1)" in plan
    assert df.count() == 1
    with pytest.raises(ValueError):
        readers.read_long(spark, path, "ratios", "hourly")


def test_resample_ties_and_nulls(spark):
    t = dt.datetime(2024, 2, 3)
    df = spark.createDataFrame([("A", t, 5.0, 2), ("A", t, 7.0, 1), ("A", dt.datetime(2024, 3, 1), 1.0, 3), (None, t, 1.0, 4), ("A", None, 1.0, 5), ("A", t, None, 6)], "company string, ts timestamp_ntz, price double, tie long")
    (r,) = timeseries.resample_prices(df, "quarterly").collect()
    assert (r.Open, r.High, r.Low, r.Close, r.Volume, r.date) == (7.0, 7.0, 1.0, 1.0, 3.0, dt.date(2024, 1, 1))


def test_returns(spark):
    df = spark.createDataFrame([("q", dt.date(2024, m, 1), "A", "Close", v) for m, v in ((1, 100.0), (2, 110.0), (3, 99.0))], STOCK)
    r = timeseries.returns(df).orderBy("date").collect()
    assert r[0].Return is None and abs(r[2]["Cumulative Return"] + 0.01) < 1e-12 and abs(r[2]["Volatility"] - math.sqrt(0.02)) < 1e-9


def test_latest_with_maps_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), (None, 1, None)], "id string, v int, m map<string,string>")
    assert {(r.id, r.v) for r in scalars.latest(df, ["id"], ["v"]).collect()} == {("a", 2), (None, 1)}
