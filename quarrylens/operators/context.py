"""Evidence blocks and other text templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "\n\n---\n\n"


def _or_na(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for label, value in pairs for x in (F.lit(f"{label}: "), value, F.lit("\n"))])


def _text(c: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), F.lit(""))


def sec_block(filing: str = "accession") -> Column:
    head = F.concat(F.lit("--- EVIDENCE ID: "), _or_na(filing), F.lit(" ---\n"))
    body = _lines(("Company", _or_na("company")), ("Period", _or_na("period")), ("Form", _or_na("form")), ("Section", _or_na("heading")), ("Sub Sections", F.coalesce("sub_heading", F.lit("{}"))), ("Content", _text("parent_text")))
    return F.concat(head, body)


def transcript_block() -> Column:
    return _lines(("Company", _or_na("company")), ("Period", _or_na("period")), ("Speaker", _or_na("speaker")), ("Title", _or_na("title")), ("Content", _text("parent_text")))


def assemble(hits: DataFrame, block: Column, by: list[str], order: str) -> DataFrame:
    """One context for each group: its blocks in order, with a rule between. Hits are few by their top-k."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["b"]), RULE).alias("context"), F.count("*").alias("n_blocks"))


def turn_envelope(company: Column, period: Column, query: Column) -> Column:
    return F.concat(F.lit("Company: "), company, F.lit(", Period: "), period, F.lit(", Query: "), query)
