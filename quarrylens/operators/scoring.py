"""Category risk scores for every company and period in one plan.

metrics: long table company, period, metric, value. Each metric is compressed if large, turned so that greater is better,
normalised within its category or against peers, and averaged by category. risk = 100 - score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.dims import ratio_groups
from quarrylens.functions.scalars import finite

# The first rule of which a part stands in the metric's name decides.
DIRECTION_RULES = [
    (["price-to", "p/e", "p/b", "ev-to", "price to"], False),
    (["margin", "return", "roe", "roa", "profit", "income", "yield", "growth", "efficiency"], True),
    (["debt", "leverage", "capex", "expense", "cost", "volatility", "tracking", "ulcer", "loss", "short"], False),
    (["per share"], True),
]
COMPRESSED = ["tangible", "working capital", "cash", "total assets", "book value", "market cap", "enterprise value", "value"]
METHODS = ("percentile", "minmax", "zscore")
GROUP = ["company", "period"]


def _has(name: Column, parts: list[str]) -> Column:
    low, out = F.lower(name), F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def higher_is_better(metric: Column, overrides: dict[str, bool] | None = None) -> Column:
    out = F.lit(True)
    for parts, good in reversed(DIRECTION_RULES):
        out = F.when(_has(metric, parts), F.lit(good)).otherwise(out)
    for name, good in (overrides or {}).items():
        out = F.when(metric == name, F.lit(good)).otherwise(out)
    return out


def compressed(metric: Column, v: Column) -> Column:
    """sign(v) * log10(|v| + 1) for large values and for magnitudes, else v."""
    return F.when((F.abs(v) >= 1e6) | _has(metric, COMPRESSED), F.signum(v) * F.log10(F.abs(v) + 1)).otherwise(v)


def adjusted(metrics: DataFrame, overrides: dict[str, bool] | None = None) -> DataFrame:
    """company, period, metric, value, good, adj: finite values, compressed and turned. What is no finite number is left out."""
    m, v = F.col("metric"), F.col("value")
    rows = metrics.select(*GROUP, "metric", finite(v).alias("value")).filter("value IS NOT NULL AND metric IS NOT NULL")
    rows = rows.withColumn("good", higher_is_better(m, overrides))
    t = compressed(m, v)
    return rows.withColumn("adj", F.when(F.col("good"), t).otherwise(-t))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _aggregate(normalised: DataFrame, least: int, scale: float) -> DataFrame:
    """company, period, category, n_metrics, score, risk."""
    g = normalised.groupBy(*GROUP, "category").agg(F.count("norm").alias("n_metrics"), F.avg("norm").alias("mean"))
    score = F.when(F.col("n_metrics") >= least, F.round(F.col("mean") * scale, 2))
    return g.select(*GROUP, "category", "n_metrics", score.alias("score"), F.round(100 - score, 2).alias("risk"))


def _categories(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows once for each category of their metric, and partitioned so that windows and aggregates of a company and period need
    no further exchange."""
    g = groups if groups is not None else ratio_groups(rows.sparkSession)
    order = F.col("cat_ord") if "cat_ord" in g.columns else F.col("category")
    return rows.join(F.broadcast(g.select("metric", "category", order.alias("cat_ord"))), "metric").repartition(*GROUP)


def _within_category(rows: DataFrame, out: str) -> DataFrame:
    """out: adj by min-max within its category; metrics all alike, or a single one, give 0.5. A metric of several categories has
    the value of its last one in all of them."""
    w = Window.partitionBy(*GROUP, "category")
    lo, hi = F.min("adj").over(w), F.max("adj").over(w)
    rows = rows.withColumns({"lo": lo, "hi": hi})
    norm = F.when(_close(F.col("hi"), F.col("lo")), 0.5).otherwise(_clip(F.try_divide(F.col("adj") - F.col("lo"), F.col("hi") - F.col("lo"))))
    return rows.withColumn(out, norm).withColumn(out, F.max_by(out, "cat_ord").over(Window.partitionBy(*GROUP, "metric"))).drop("lo", "hi")


def scores_without_peers(metrics: DataFrame, overrides: dict[str, bool] | None = None, least: int = 1, scale: float = 100.0, groups: DataFrame | None = None) -> DataFrame:
    """Min-max within each category of a company and period; a single metric, or metrics all alike, give 0.5.

    One exchange: windows and aggregation share their keys. Categories without a finite metric give no row (see with_gaps).
    """
    rows = adjusted(metrics, overrides).select(*GROUP, "metric", "adj")
    return _aggregate(_within_category(_categories(rows, groups), "norm"), least, scale)


def with_gaps(scores: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Adds a null row for each category that a company and period has no score in."""
    g = groups if groups is not None else ratio_groups(scores.sparkSession)
    cats = F.array(*[F.lit(r.category) for r in g.select("category").distinct().orderBy("category").collect()])
    every = scores.select(*GROUP).distinct().withColumn("category", F.explode(cats))
    return every.join(scores, [*GROUP, "category"], "left")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7, in built-in functions."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def _against_peers(rows: DataFrame, of: DataFrame | None, method: str, winsor: float) -> DataFrame:
    """rows (company, period, metric, adj) with norm and has_peers. of: period, metric, adj of the peers; None: all rows.

    Values and peers lie in one window by period and metric: one exchange and one sort. A value is clipped to the peers'
    percentiles winsor and 1 - winsor, which are interpolated; the peers themselves stay as they are.
    """
    both = rows.withColumns({"own": F.lit(True), "peer": F.lit(1 if of is None else 0)})
    if of is not None:
        both = both.unionByName(of.select(F.lit(None).cast("string").alias("company"), "period", "metric", "adj", F.lit(False).alias("own"), F.lit(1).alias("peer")))
    every = Window.partitionBy("period", "metric")
    sorted_ = every.orderBy("adj")
    peer = lambda c: F.when(F.col("peer") == 1, c)
    both = both.withColumns(
        {
            "n": F.sum("peer").over(every),
            "place": F.sum("peer").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)) - 1,
            "upto": F.sum("peer").over(sorted_.rangeBetween(Window.unboundedPreceding, 0)),
            "same": F.sum("peer").over(sorted_.rangeBetween(0, 0)),
        }
    )
    bounds = {}
    for name, share in (("lo", winsor), ("hi", 1 - winsor)):
        at = F.lit(share) * (F.col("n") - 1)
        low, high = (F.max(peer(F.when(F.col("place") == f(at), F.col("adj")))).over(every) for f in (F.floor, F.ceil))
        bounds[name] = low + (high - low) * (at - F.floor(at))
    both = both.withColumns(bounds)
    a, lo, hi, has = F.col("adj"), F.col("lo"), F.col("hi"), F.col("n") > 0
    x = F.when(has, F.least(F.greatest(a, lo), hi)).otherwise(a)
    if method == "percentile":
        count = lambda c: F.sum(F.when(c, F.col("peer")).otherwise(0)).over(every)
        both = both.withColumns({"lo_less": count(a < lo), "lo_same": count(a == lo), "hi_less": count(a < hi), "hi_same": count(a == hi)})
        less = F.when(a < lo, F.col("lo_less")).when(a > hi, F.col("hi_less")).otherwise(F.col("upto") - F.col("same"))
        same = F.when(a < lo, F.col("lo_same")).when(a > hi, F.col("hi_same")).otherwise(F.col("same"))
        norm = (less + 0.5 * same) / F.col("n")
    elif method == "minmax":
        both = both.withColumns({"mn": F.min(peer(a)).over(every), "mx": F.max(peer(a)).over(every)})
        norm = F.when(_close(F.col("mx"), F.col("mn")), 0.5).otherwise(F.try_divide(x - F.col("mn"), F.col("mx") - F.col("mn")))
    else:
        both = both.withColumns({"mu": F.avg(peer(a)).over(every), "sd": F.stddev_pop(peer(a)).over(every)})
        norm = F.when(F.col("sd") > 1e-12, (x - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return both.filter("own").select(*GROUP, "metric", "adj", has.alias("has_peers"), F.when(has, norm).otherwise(a).alias("norm"))


def scores_with_peers(
    metrics: DataFrame, peers: DataFrame | None = None, method: str = "percentile", winsor: float = 0.01, overrides: dict[str, bool] | None = None, least: int = 1, scale: float = 100.0, groups: DataFrame | None = None, probability: str = "normal"
) -> DataFrame:
    """Scores against peers: all companies with the metric in the same period, or a table period, metric, value of one's own.

    percentile: (less + half of equal) / n. minmax: 0.5 where the peers are all alike. zscore: with population deviation, 0 where
    that is 0; turned into a probability by the normal distribution, or by rank within the category (probability="rank").
    A metric without peers keeps its adjusted value (with zscore: the probability of that), clipped to 0..1. With percentile, a
    company and period of which no metric at all has peers is scored within its categories instead, as without peers.

    Two exchanges: one by period and metric for the peers, one by company and period for gate, categories and scores.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    rows = adjusted(metrics, overrides).select(*GROUP, "metric", "adj")
    of = None if peers is None else adjusted(peers.select(F.lit("").alias("company"), "period", "metric", "value"), overrides).select("period", "metric", "adj")
    rows = _categories(_against_peers(rows, of, method, winsor), groups)
    if method == "percentile":
        rows = _within_category(rows, "inner").withColumn("any_peer", F.max("has_peers").over(Window.partitionBy(*GROUP)))
        norm = F.when(F.col("any_peer"), _clip(F.col("norm"))).otherwise(F.col("inner"))
    elif method == "minmax":
        norm = _clip(F.col("norm"))
    elif probability == "normal":
        norm = normal_cdf(F.col("norm"))
    else:
        rows = average_rank(rows, [*GROUP, "category"], "norm", "place")
        of_all = F.count("*").over(Window.partitionBy(*GROUP, "category"))
        norm = F.when(of_all > 1, (F.col("place") - 1) / (of_all - 1)).otherwise(0.5)
    return _aggregate(rows.withColumn("norm", norm), least, scale)


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank with ties averaged, within groups."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def category_scores(metrics: pd.Series | dict, **options) -> dict:
    """Scores of one metric vector on the driver, for interactive use; the same plan over a one-row group."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [("", "", str(k), None if v is None else float(v)) for k, v in dict(metrics).items()]
    df = spark.createDataFrame(rows, "company string, period string, metric string, value double")
    return {r.category: r.risk for r in with_gaps(scores_without_peers(df, **options)).collect()}
