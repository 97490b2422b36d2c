"""Queries that write with a sink and read back with a source: what comes out is compared with the table that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import graph, search
from quarrylens.plans import inputs
from quarrylens.session import scratch
from quarrylens.sources import readers
from quarrylens.sources.readers import read_table


def timeframe_routing(spark, d):
    """Monthly and yearly bars in one table by timeframe, of which one is read."""
    path = scratch(spark, "long")
    readers.write_long(readers.union_all(inputs.stocks(spark, d, "monthly"), inputs.stocks(spark, d, "yearly")), path)
    s = readers.read_long(spark, path, "stocks", "yearly")
    return s.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "company", "variable", F.round("value", 4).alias("value"))


def csv_filing_scan(spark, d):
    """Filings as one CSV for each ticker, read back with the ticker from the file's name."""
    path = scratch(spark, "csv")
    f = read_table(spark, d, "filings").select(F.upper(F.trim("ticker")).alias("ticker"), "filing_date", "accession_number").filter("ticker IS NOT NULL").distinct()
    f.repartition("ticker").write.partitionBy("ticker").option("header", True).csv(path)
    return readers.read_filing_csvs(spark, f"{path}/*", r"ticker=([^/]+)/", 2010).select("ticker", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "accession_number")


def json_chunk_scan(spark, d):
    """Chunks as arrays of records, read back by their mapper."""
    path = scratch(spark, "json")
    c = inputs.chunks(spark, d, "accession_no", "company", "form", "filing_date", "item_heading", "part_heading", "is_table", "sub_headings", "parent_chunk", "child_chunks")
    meta = F.struct("item_heading", "part_heading", "filing_date", "company", "form", "is_table", "accession_no", "sub_headings")
    readers.write_json(c.select(F.col("chunk_id").alias("ID"), meta.alias("Metadata"), F.struct("parent_chunk", "child_chunks").alias("Chunks")), path)
    r = readers.read_sec_json(spark, path, lines=True)
    return r.select("chunk_id", "accession_no", "form", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "item_heading", "is_table", F.md5("parent_chunk").alias("digest"), F.coalesce(F.size("child_chunks"), F.lit(0)).alias("n_children"))


def graph_sink(spark, d):
    """Every node and edge of the filings' graph, from its written tables: label, key or source, and what it leads to."""
    path = scratch(spark, "graph")
    c = inputs.chunks(spark, d, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks")
    tables = graph.sec_graph(c, inputs.filings(spark, d))
    readers.write_graph(tables, path)
    out = None
    for name in tables:
        t = spark.read.parquet(f"{path}/{name}")
        key, to = {"company": ("name", None), "filing": ("accession", "period"), "heading": ("name", "accession"), "parent_chunk": ("chunk_id", "sub_heading_dict"), "child_chunk": ("chunk_id", "content")}.get(name, ("src", "dst"))
        dst = F.lit(None).cast("string") if to is None else F.md5(to) if to in ("content", "sub_heading_dict") else F.col(to)
        part = t.select(F.lit(name).alias("label"), F.col(key).alias("src"), dst.alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out


def vector_index_topk(spark, d):
    """The ten nearest from a written index."""
    path = scratch(spark, "index")
    v = read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    dim = v.filter("id = 0").select(F.size("embedding").alias("n")).first().n
    search.build_index(v, path, dim)
    hits = search.index_top_k(spark, path, list(v.filter("id = 0").select("embedding").first()[0]), 10)
    return hits.select("id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (timeframe_routing, csv_filing_scan, json_chunk_scan, graph_sink, vector_index_topk)}
