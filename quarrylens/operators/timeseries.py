"""Questions over long tables entity x metric x period: charts, ratio tables, point lookups.

Long tables have company, period or date, metric or variable, and value. Filters on company, metric and period reach the scan;
the wide form is made last, from at most as many columns as were asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.functions.scalars import finite

OHLC = ["Open", "High", "Low", "Close"]


def resample_prices(ticks: DataFrame, timeframe: str, company: str = "company", ts: str = "ts", price: str = "price", tie: str = "tie") -> DataFrame:
    """timeframe, date (period start), company, Open, High, Low, Close, Volume; ties in time are broken by `tie`.

    One hash aggregation by (company, period) with partial sums; rows with a null company, time or price are left out.
    """
    t = ticks.select(F.col(company).alias("company"), F.col(ts).alias("ts"), F.col(price).cast("double").alias("price"), F.col(tie).alias("tie"))
    t = t.filter("company IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL")
    at = F.struct("ts", "tie", "price")
    g = t.groupBy("company", periods.trunc_to(F.col("ts"), timeframe).alias("date")).agg(
        F.min(at).getField("price").alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max(at).getField("price").alias("Close"), F.count("*").cast("double").alias("Volume")
    )
    return g.select(F.lit(timeframe).alias("timeframe"), "date", "company", *OHLC, "Volume")


def melt(wide: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """The long form of any wide table."""
    return wide.unpivot(ids, values, variable, value)


def chart(series: DataFrame, company: str, variables: list[str]) -> DataFrame:
    """date (text) and a column for each requested variable that the company has, in the order asked; none of them gives no rows.

    Not finite values are null. The look at which variables exist reads at most one row for each requested one.
    """
    rows = series.filter((F.col("company") == company) & F.col("variable").isin(variables))
    there = {r.variable for r in rows.select("variable").distinct().collect()}
    present = [v for v in dict.fromkeys(variables) if v in there]
    date = F.date_format("date", "yyyy-MM-dd").alias("date")
    if not present:
        return rows.select(date).filter(F.lit(False))
    return rows.select(date, "variable", finite(F.col("value")).alias("value")).groupBy("date").pivot("variable", present).agg(F.first("value", True)).orderBy("date")


def candles(series: DataFrame, company: str, variables: list[str]) -> DataFrame:
    """x (epoch milliseconds), name, y: one series "candles" with [open, high, low, close] if exactly these four are asked for,
    otherwise a series of one-element arrays for each variable."""
    rows = series.filter((F.col("company") == company) & F.col("variable").isin(variables)).withColumn("value", finite(F.col("value")))
    x = F.unix_millis(F.col("date").cast("timestamp")).alias("x")
    if sorted(set(variables)) == sorted(OHLC):
        four = [F.max(F.when(F.col("variable") == v, F.col("value"))) for v in OHLC]
        return rows.groupBy(x).agg(F.array(*four).alias("y")).select("x", F.lit("candles").alias("name"), "y")
    return rows.select(x, F.col("variable").alias("name"), F.array("value").alias("y"))


def _of_company(table: DataFrame, company: str, must_exist: bool) -> DataFrame:
    rows = table.filter(F.col("company") == company)
    if must_exist and rows.limit(1).count() == 0:
        raise KeyError(company)
    return rows


def ratio_table(ratios: DataFrame, company: str, metrics: list[str] | None = None, columns: list[str] | None = None, must_exist: bool = False) -> DataFrame:
    """metric and a column for each period. Requested metrics keep their order, unknown ones give null rows; no request gives all,
    by name. columns: the periods, else those of the company (a small look ahead). An absent company raises if must_exist."""
    rows = _of_company(ratios, company, must_exist)
    periods_ = columns or sorted(r.period for r in rows.select("period").distinct().collect())
    wide = rows.groupBy("metric").pivot("period", periods_).agg(F.first(finite(F.col("value")), True))
    if not metrics:
        return wide.orderBy("metric")
    asked = ratios.sparkSession.createDataFrame(list(enumerate(metrics)), "ord int, metric string")
    return F.broadcast(asked).join(wide, "metric", "left").orderBy("ord").drop("ord").select("metric", *periods_)


def reindexed(ratios: DataFrame, company: str, metrics: list[str]) -> DataFrame:
    """ord, metric, period, value in long form; a metric the company lacks gives one row with null period and value."""
    asked = ratios.sparkSession.createDataFrame([(i + 1, m) for i, m in enumerate(metrics)], "ord int, metric string")
    rows = ratios.filter(F.col("company") == company).select("metric", "period", finite(F.col("value")).alias("value"))
    return F.broadcast(asked).join(rows, "metric", "left").select("ord", "metric", "period", "value")


def at_period(table: DataFrame, company: str | None, period: str, metrics: list[str] | None = None) -> DataFrame:
    """company, period, metric, value at one period, given as Q3_2024, 2024Q3, FY_2024 or 2024; a miss gives no rows."""
    code = periods.to_code(F.lit(period))
    rows = table.filter(F.col("period") == code)
    if company is not None:
        rows = rows.filter(F.col("company") == company)
    if metrics:
        rows = rows.filter(F.col("metric").isin(metrics))
    return rows.select("company", "period", "metric", finite(F.col("value")).alias("value"))


def point(table: DataFrame, company: str, period: str) -> DataFrame:
    """The metric vector of one company and period; raises KeyError if there is none."""
    rows = at_period(table, company, period).select("metric", "value")
    if rows.limit(1).count() == 0:
        raise KeyError((company, period))
    return rows


def first_present(wide: DataFrame, metric: str, company: str) -> Column:
    """metric|company, else metric, else null."""
    names = [n for n in (f"{metric}|{company}", metric) if n in wide.columns]
    return F.coalesce(*[F.col(f"`{n}`") for n in names]) if names else F.lit(None).cast("double")


def returns(series: DataFrame, variable: str = "Close") -> DataFrame:
    """Extension: company, date, Return, Cumulative Return, Volatility (of the returns so far) from one price variable."""
    w = Window.partitionBy("company").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = series.filter(F.col("variable") == variable).select("company", "date", finite(F.col("value")).alias("p"))
    r = v.withColumn("Return", F.try_divide(F.col("p"), F.lag("p").over(w)) - 1)
    grown = F.when(F.col("Return") > -1, F.log1p("Return"))
    return r.select("company", "date", "Return", (F.exp(F.sum(grown).over(upto)) - 1).alias("Cumulative Return"), F.stddev_samp("Return").over(upto).alias("Volatility"))
