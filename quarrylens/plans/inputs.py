"""The catalogue's inputs, made from whole tables: long metric tables from orders and line items, cleaned filings and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.operators import graph, timeseries
from quarrylens.sources.readers import read_table


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """company (nation), ts, price, tie: every order as a price."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = o.join(c, "o_custkey").join(n, "c_nationkey")
    return j.select(F.col("n_name").alias("company"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("tie"))


def stocks(spark: SparkSession, d: str, timeframe: str = "quarterly") -> DataFrame:
    wide = timeseries.resample_prices(ticks(spark, d), timeframe)
    return timeseries.melt(wide, ["timeframe", "date", "company"], [*timeseries.OHLC, "Volume"])


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """company, metric, period, value: twelve quotients of a quarter's line items. Sums are exact, so that they don't depend on
    the order of rows."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    ext = F.col("l_extendedprice")
    # ten-thousandths as integers: exact sums without wide decimals. Line items are summed by order before the join, which then
    # finds them partitioned by its key and a quarter as many; and orders are counted without a distinct.
    whole = lambda x: F.sum(F.round(x * 10000).cast("long"))
    by_order = li.groupBy("l_orderkey").agg(
        whole(ext).alias("ext"), whole(ext * F.col("l_discount")).alias("disc"), whole(ext * F.col("l_tax")).alias("tax"), whole(F.col("l_quantity")).alias("qty"),
        F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("ret"), F.sum((F.col("l_linestatus") == "O").cast("long")).alias("op"),
    )
    j = by_order.join(o, "l_orderkey").join(c, "o_custkey").join(n, "c_nationkey")
    g = j.groupBy(F.col("n_name").alias("company"), periods.code_of(F.col("o_orderdate"), "quarterly").alias("period"))
    g = g.agg(*[(F.sum(x) / 10000.0).alias(x) for x in ("ext", "disc", "tax", "qty")], *[F.sum(x).cast("double").alias(x) for x in ("n", "ret", "op")], F.count("*").cast("double").alias("ords"))
    e, s, t, q, k = (F.col(x) for x in ("ext", "disc", "tax", "qty", "n"))
    wide = {
        "Price-to-Earnings": F.try_divide(e, e - s),
        "Price-to-Book": F.try_divide(e, q),
        "EV-to-Sales": F.try_divide(e + t, e - s),
        "Gross Margin": F.try_divide(e - s, e),
        "Net Profit Margin": F.try_divide(e - s - t, e),
        "Return on Equity": F.try_divide(F.col("ret"), k),
        "Current Ratio": F.try_divide(k - F.col("op"), F.col("op")),
        "Cash Ratio": F.try_divide(t, s),
        "Asset Turnover Ratio": F.try_divide(k, F.col("ords")),
        "Inventory Turnover Ratio": F.try_divide(q, k),
        "Debt-to-Equity Ratio": F.try_divide(s, t),
        "Cash Conversion Efficiency": F.try_divide(e - s, e - t),
    }
    w = g.select("company", "period", *[F.round(v, 6).alias(k) for k, v in wide.items()])
    return timeseries.melt(w, ["company", "period"], list(wide), "metric").filter("value IS NOT NULL")


def filings(spark: SparkSession, d: str) -> DataFrame:
    return graph.filing_labels(graph.clean_filings(read_table(spark, d, "filings"), read_table(spark, d, "companies")))


def chunks(spark: SparkSession, d: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    """only: the chunk_ids that are wanted; the others are left out before any text is moved, and the version is then found on the
    same partitioning."""
    c = read_table(spark, d, "sec_chunks")
    if only is not None:
        c = c.join(only, "chunk_id", "left_semi")
    return graph.clean_sec_chunks(c.select("chunk_id", "ingested_at", *columns) if columns else c)


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return graph.clean_transcripts(read_table(spark, d, "transcript_chunks"), read_table(spark, d, "companies"))


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    from quarrylens.functions.scalars import latest

    t = read_table(spark, d, "conversation_turns")
    t = t.select("id", "asked_at", *columns) if columns else t
    return latest(t.filter("id IS NOT NULL"), ["id"], ["asked_at"])
