"""Readers and writers with explicit schemas; malformed or missing inputs are skipped or reported, never guessed at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.dims import TIMEFRAMES

LONG = {
    "stocks": "timeframe string, date date, company string, variable string, value double",
    "ratios": "timeframe string, company string, metric string, period string, value double",
    "metrics": "timeframe string, company string, metric string, period string, value double",
}
FILING_CSV = "filing_date date, accession_number string"
SEC_JSON = "ID string, Metadata struct<item_heading:string,part_heading:string,filing_date:date,company:string,form:string,is_table:boolean,accession_no:string,sub_headings:map<string,string>>, Chunks struct<parent_chunk:string,child_chunks:map<string,string>>"
TRANSCRIPT_JSON = "transcript array<struct<Metadata:struct<quarter:string,year:int,company:string,speaker:string,title:string>,ParentChunk:struct<ID:string,chunk:string>,ChildChunks:map<string,string>>>"


def read_long(spark: SparkSession, path: str, dataset: str, timeframe: str | None = None) -> DataFrame:
    """A long table that is partitioned by timeframe; naming one prunes the others at the scan."""
    if dataset not in LONG:
        raise ValueError(f"unknown dataset: {dataset}")
    if timeframe is not None and timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe: {timeframe}")
    df = spark.read.schema(LONG[dataset]).parquet(path)
    return df if timeframe is None else df.filter(F.col("timeframe") == timeframe)


def write_long(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("timeframe").parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_filing_csvs(spark: SparkSession, glob: str, ticker_pattern: str = r"([^/_]+)_[^/]*\.csv$", min_year: int | None = None) -> DataFrame:
    """ticker, filing_date, accession_number from one CSV for each ticker; the ticker is taken from the file's name. Lines that
    don't parse have nulls and are dropped."""
    df = spark.read.schema(FILING_CSV).option("header", True).option("mode", "PERMISSIVE").csv(glob)
    df = df.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_path"), ticker_pattern, 1)).filter("accession_number IS NOT NULL AND filing_date IS NOT NULL")
    return df if min_year is None else df.filter(F.year("filing_date") > min_year)


def read_sec_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chunk files (arrays of records, or a record a line) in the shape of the sec_chunks table."""
    j = spark.read.schema(SEC_JSON).option("multiLine", not lines).json(path)
    m = "Metadata."
    return j.select(
        F.col("ID").alias("chunk_id"), F.col(m + "accession_no").alias("accession_no"), F.col(m + "company").alias("company"), F.col(m + "form").alias("form"), F.col(m + "filing_date").alias("filing_date"),
        F.coalesce(F.col(m + "item_heading"), F.lit("Not Found")).alias("item_heading"), F.col(m + "part_heading").alias("part_heading"), F.coalesce(F.col(m + "is_table"), F.lit(False)).alias("is_table"),
        F.col(m + "sub_headings").alias("sub_headings"), F.col("Chunks.parent_chunk").alias("parent_chunk"), F.col("Chunks.child_chunks").alias("child_chunks"),
    )


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Call files in the shape of the transcript_chunks table."""
    t = spark.read.schema(TRANSCRIPT_JSON).option("multiLine", True).json(path).select(F.explode("transcript").alias("t"))
    m = "t.Metadata."
    return t.select(
        F.col("t.ParentChunk.ID").alias("chunk_id"), F.col(m + "company").alias("company"), F.col(m + "quarter").alias("fiscal_quarter"), F.col(m + "year").alias("fiscal_year"), F.col(m + "speaker").alias("speaker"),
        F.col(m + "title").alias("title"), F.col("t.ParentChunk.chunk").alias("chunk"), F.col("t.ChildChunks").alias("child_chunks"),
    )


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table for each node and edge label."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
