"""Constant dimensions. These lists define the domain and are not to be derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RATIO_GROUPS: dict[str, list[str]] = {
    "Valuation": ["Price-to-Earnings", "Price-to-Book", "EV-to-EBITDA", "EV-to-Sales", "Price-to-Free-Cash-Flow"],
    "Profitability": ["Gross Margin", "Operating Margin", "Net Profit Margin", "Return on Equity"],
    "Liquidity": ["Current Ratio", "Quick Ratio", "Cash Ratio"],
    "Efficiency": ["Asset Turnover Ratio", "Inventory Turnover Ratio"],
    "Leverage": ["Debt-to-Equity Ratio", "Debt-to-Assets Ratio"],
    "Cash Flow": ["Cash Conversion Efficiency", "CAPEX Coverage Ratio"],
}

TIMEFRAMES = ["daily", "weekly", "monthly", "quarterly", "yearly"]
QUERY_TYPES = ["GENERAL", "SIMPLE", "BROAD", "COMPARISON", "CHANGE_DETECTION"]
FORMS = ["10-K", "10-Q"]

HEADINGS_10K = [
    "business",
    "risk factors",
    "legal proceedings",
    "properties",
    "management discussion and analysis of financial condition and results of operations",
    "quantitative and qualitative disclosures about market risk",
    "financial statements and supplementary data",
    "controls and procedures",
    "market for registrant's common equity, related stockholder matters and issuer purchases of equity securities",
    "executive compensation",
    "security ownership of certain beneficial owners and management and related stockholder matters",
    "certain relationships and related transactions and director independence",
    "directors, executive officers and corporate governance",
    "principal accountant fees and services",
    "unresolved staff comments",
    "cybersecurity",
    "other information",
    "exhibits and financial statement schedules",
    "10-k summary",
]
HEADINGS_10Q = [
    "financial statements",
    "management discussion and analysis of financial condition and results of operations",
    "risk factors",
    "legal proceedings",
    "quantitative and qualitative disclosures about market risk",
    "controls and procedures",
    "unregistered sales of equity securities and use of proceeds",
    "exhibits",
    "other information",
]

# Words of a question that point to a heading, most telling first.
SECTION_CUES = [
    ("risk", "risk factors"),
    ("lawsuit|litigation|legal", "legal proceedings"),
    ("market risk|interest rate|foreign exchange|currency", "quantitative and qualitative disclosures about market risk"),
    ("cyber|data breach", "cybersecurity"),
    ("margin|revenue|cash flow|growth|trend|drove|headcount|spending", "management discussion and analysis of financial condition and results of operations"),
    ("balance sheet|inventory|debt|tax|capital expenditure|reserves", "financial statements"),
    ("control|audit", "controls and procedures"),
    ("business|product|segment", "business"),
]


def ratio_groups(spark: SparkSession) -> DataFrame:
    """category, cat_ord, metric, metric_ord: 18 rows, safe to broadcast."""
    rows = [(c, i, m, j) for i, (c, ms) in enumerate(RATIO_GROUPS.items(), 1) for j, m in enumerate(ms, 1)]
    return spark.createDataFrame(rows, "category string, cat_ord int, metric string, metric_ord int")


def zipped(spark: SparkSession, keys: list, names: list[str], key: str = "cik", name: str = "display_name") -> DataFrame:
    """Two constant lists joined by position; of different lengths they are an error."""
    if len(keys) != len(names):
        raise ValueError("the lists differ in length")
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(zip(keys, names))], f"ord int, {key} long, {name} string")
