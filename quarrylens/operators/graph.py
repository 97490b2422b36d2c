"""Filings and calls as a property graph in tables: nodes, edges, period labels, chains, filtered hierarchies, change walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.functions.scalars import any_hint, company_key, form_key, latest, n_words

NO_HEADING = "Not Found"


# ---- cleaning -----------------------------------------------------------------------------------------------------------


def clean_filings(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """accession, ticker, company (display name), form, date: one row an accession; an amended form (10-K/A) counts as its form.
    Rows without an accession, or of no known ticker, are left out."""
    f = filings.select(
        F.col("accession_number").alias("accession"), F.upper(F.trim("ticker")).alias("ticker"), F.regexp_replace(form_key(F.col("form")), "/A$", "").alias("form"), F.col("filing_date").alias("date")
    ).filter("accession IS NOT NULL")
    return latest(f, ["accession"], ["date"]).join(companies.select("ticker", F.col("display_name").alias("company")), "ticker")


def clean_sec_chunks(chunks: DataFrame) -> DataFrame:
    """The latest row of each chunk_id."""
    return latest(chunks.filter("chunk_id IS NOT NULL"), ["chunk_id"], ["ingested_at"])


def named_companies(df: DataFrame, companies: DataFrame, column: str = "company") -> DataFrame:
    """df with the display name of each company in place of its spelling; rows of unknown companies are left out."""
    names = companies.select(company_key(F.col("display_name")).alias("_k"), F.col("display_name").alias("_n")).filter("_k IS NOT NULL").dropDuplicates(["_k"])
    rest = [c for c in df.columns if c != column]
    return df.withColumn("_k", company_key(F.col(column))).join(names, "_k").select(*rest, F.col("_n").alias(column))


# ---- period labels and chains -------------------------------------------------------------------------------------------


def filing_labels(filings: DataFrame) -> DataFrame:
    """filings with period: a 10-Q is numbered among its company's 10-Qs of the calendar year, by date and accession; a 10-K is
    FY_year. No date gives a null period."""
    w = Window.partitionBy("company", "form", F.year("date")).orderBy("date", "accession")
    quarter = F.concat(F.lit("Q"), F.row_number().over(w).cast("string"), F.lit("_"), F.year("date").cast("string"))
    year = F.concat(F.lit("FY_"), F.year("date").cast("string"))
    return filings.withColumn("period", F.when(F.col("date").isNull(), None).when(F.col("form") == "10-Q", quarter).when(F.col("form") == "10-K", year))


def filing_chain(filings: DataFrame) -> DataFrame:
    """filings with seq, the place in the chain of its company and form by date, and next, the accession that follows."""
    w = Window.partitionBy("company", "form").orderBy("date", "accession")
    return filings.filter("date IS NOT NULL").withColumns({"seq": F.row_number().over(w), "next": F.lead("accession").over(w)})


def next_edges(chain: DataFrame) -> DataFrame:
    return chain.filter("next IS NOT NULL").select(F.col("accession").alias("src"), F.col("next").alias("dst"))


def transcript_chain(transcripts: DataFrame, compat: bool = False) -> DataFrame:
    """src, dst of consecutive transcripts (id, company, period): in time, or by the period's text if compat."""
    order = F.col("period") if compat else periods.sort_key(F.col("period"))
    w = Window.partitionBy("company").orderBy(order, "id")
    return transcripts.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).filter("dst IS NOT NULL")


# ---- nodes and edges ----------------------------------------------------------------------------------------------------


def merge_nodes(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last written one."""
    return latest(df, key, order)


def merge_edges(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def sec_graph(chunks: DataFrame, filings: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables of the filings' side. chunks: clean_sec_chunks(); filings: filing_labels()."""
    heading = F.coalesce("item_heading", F.lit(NO_HEADING))
    c = chunks.select("*", heading.alias("heading"))
    child = c.select("chunk_id", F.explode("child_chunks").alias("child_id", "content"))
    filed = c.join(filings.select(F.col("accession").alias("accession_no"), "company"), "accession_no") if "company" not in c.columns else c
    return {
        "company": filings.select(F.col("company").alias("name")).distinct(),
        "filing": filings.select("accession", "form", "date", "period"),
        "heading": c.select(F.col("heading").alias("name"), F.col("accession_no").alias("accession")).distinct(),
        "parent_chunk": c.select("chunk_id", F.col("parent_chunk").alias("content"), sub_heading_json().alias("sub_heading_dict"), "is_table"),
        "child_chunk": child.select(F.col("child_id").alias("chunk_id"), "content"),
        "filed": merge_edges(filings, F.col("company"), F.col("accession")),
        "has_section": merge_edges(filed, F.col("accession_no"), F.concat_ws("|", "heading", "accession_no")),
        "has_content": merge_edges(c, F.concat_ws("|", "heading", "accession_no"), F.col("chunk_id")),
        "has_child": merge_edges(child, F.col("chunk_id"), F.col("child_id")),
    }


def sub_heading_json() -> Column:
    """Sub-headings as JSON with sorted keys, {} for none."""
    entries = F.array_sort(F.map_entries("sub_headings"))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def transcript_id(company: Column, period: Column) -> Column:
    return F.concat_ws("_", company, period)


def clean_transcripts(chunks: DataFrame, companies: DataFrame) -> DataFrame:
    """The latest row of each chunk with its company's display name, period (Q1_2024) and transcript id."""
    t = latest(chunks.filter("chunk_id IS NOT NULL"), ["chunk_id"], ["ingested_at"])
    t = named_companies(t, companies).withColumn("period", F.concat_ws("_", "fiscal_quarter", F.col("fiscal_year").cast("string")))
    return t.withColumn("transcript_id", transcript_id(F.col("company"), F.col("period")))


def transcripts_with_filing(transcripts: DataFrame, filings: DataFrame) -> DataFrame:
    """Those with a 10-Q of the same company and period; the others are dropped."""
    q = filings.filter("form = '10-Q' AND period IS NOT NULL").select("company", "period").distinct()
    return transcripts.join(q, ["company", "period"], "left_semi")


def embedding_check(children: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children with their vector, children that lack one). Both are joins; nothing is collected."""
    v = vectors.select(F.col("id").alias("chunk_id"), F.col("openai_embedding").alias("embedding")).dropDuplicates(["chunk_id"])
    return children.join(v, "chunk_id"), children.join(v, "chunk_id", "left_anti")


def with_embedding(children: DataFrame, vectors: DataFrame) -> DataFrame:
    """Children with their vector; a child without one is an error when the rows are computed."""
    v = vectors.select(F.col("id").alias("chunk_id"), F.col("openai_embedding").alias("embedding")).dropDuplicates(["chunk_id"])
    rows = children.join(v, "chunk_id", "left")
    missing = F.raise_error(F.concat(F.lit("no embedding for "), F.col("chunk_id"))).cast(v.schema["embedding"].dataType)
    return rows.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(missing))


# ---- hierarchy ----------------------------------------------------------------------------------------------------------


def sec_hierarchy(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    """company, accession, form, period, date, heading, parent_id, parent_text, is_table, sub_heading, child_id, child_text: the
    four-hop path as one join on the accession and an unnesting of the children. Parents without children are not on it."""
    p = sec_parents(chunks, filings)
    return p.select("*", F.explode("children").alias("child_id", "child_text")).drop("children")


def sec_parents(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    c = chunks.select(
        F.col("accession_no").alias("accession"), F.coalesce("item_heading", F.lit(NO_HEADING)).alias("heading"), F.col("chunk_id").alias("parent_id"), F.col("parent_chunk").alias("parent_text"), "is_table", sub_heading_json().alias("sub_heading"), F.col("child_chunks").alias("children")
    )
    return c.join(filings.select("company", "accession", "form", "period", "date"), "accession")


def transcript_hierarchy(transcripts: DataFrame) -> DataFrame:
    """company, period, transcript_id, speaker, title, parent_id, parent_text, child_id, child_text. Speaker and title may be null."""
    return transcripts.select(
        "company", "period", "transcript_id", "speaker", F.nullif("title", F.lit("")).alias("title"), F.col("chunk_id").alias("parent_id"), F.col("chunk").alias("parent_text"), F.explode("child_chunks").alias("child_id", "child_text")
    )


def matches(company: str | None = None, periods_: list[str] | None = None, forms: list[str] | None = None, headings: list[str] | None = None, exact_company: bool = False) -> Column:
    """The filter of a search; what is not given passes. Predicates are added only where given, so that they reach the scan."""
    out = F.lit(True)
    if company is not None:
        out = out & ((F.col("company") == company) if exact_company else F.contains(F.lower("company"), F.lit(company.lower())))
    if periods_:
        out = out & F.col("period").isin(periods_)
    if forms:
        out = out & F.col("form").isin(forms)
    if headings:
        out = out & any_hint(F.col("heading"), headings)
    return out


# ---- change detection ---------------------------------------------------------------------------------------------------


def change_walk(parents: DataFrame, chain: DataFrame, company: str, start: str, end: str, headings: list[str] | None = None) -> DataFrame:
    """Every parent of the filings on the chain from the period `start` to the period `end`, both of one form.

    A chain is numbered, so the walk is a range of numbers: no recursion and no join of the chain with itself. Distinct rows company, period, seq, accession, form,
    heading, parent_id, parent_text, sub_heading. A start after the end gives none.
    """
    form = Window.partitionBy("form")
    s0, s1 = F.min(F.when(F.col("period") == start, F.col("seq"))).over(form), F.max(F.when(F.col("period") == end, F.col("seq"))).over(form)
    path = chain.filter(F.col("company") == company).select("accession", "seq", s0.alias("s0"), s1.alias("s1")).filter("seq BETWEEN s0 AND s1").select("accession", "seq")
    rows = parents.filter((F.col("company") == company) & any_hint(F.col("heading"), headings or [])).join(path, "accession")
    return rows.select("company", "period", "seq", "accession", "form", "heading", "parent_id", "parent_text", "sub_heading").distinct()


def period_bounds(labels: Column, compat: bool = False) -> tuple[Column, Column]:
    """First and last label of an array: in time, or by text if compat."""
    if compat:
        return F.array_min(labels), F.array_max(labels)
    keyed = F.transform(labels, lambda p: F.struct(periods.sort_key(p).alias("k"), p.alias("p")))
    return F.array_min(keyed)["p"], F.array_max(keyed)["p"]


# ---- records ------------------------------------------------------------------------------------------------------------

SEC_FIELDS = ["child_id", "child_text", "parent_id", "parent_text", "sub_heading", "heading", "period", "form", "company", "accession", "score"]

# a transcript hit's fields and path, and those of a parent on a change walk
TRANSCRIPT_FIELDS = ["child_id", "child_text", "parent_id", "parent_text", "speaker", "title", "period", "company", "transcript_id", "score"]
TRANSCRIPT_PATH = [("Company", "company"), ("Transcript", "transcript_id"), ("ParentChunk", "parent_id"), ("ChildChunk", "child_id")]
CHANGE_FIELDS = ["parent_id", "parent_text", "sub_heading", "heading", "period", "form", "company", "accession"]
CHANGE_PATH = [("Company", "company"), ("Filing", "accession"), ("Heading", "heading"), ("ParentChunk", "parent_id")]


def record(hits: DataFrame, fields: list[str], path: list[tuple[str, str]], links: list[str]) -> DataFrame:
    """content: the fields as one struct; graph_ui: the nodes (labels, properties) and relations of the path to the hit."""
    nodes = F.array(*[F.struct(F.array(F.lit(label)).alias("labels"), F.create_map(F.lit("key"), F.col(c).cast("string")).alias("props")) for label, c in path])
    rels = F.array(*[F.struct(F.lit(x).alias("type"), F.create_map(F.lit("to"), F.lit(path[i + 1][0])).alias("props")) for i, x in enumerate(links)])
    keep = [c for c in ("job_id", "rank", "seq") if c in hits.columns]
    return hits.select(*keep, F.struct(*fields).alias("content"), F.struct(nodes.alias("nodes"), rels.alias("rels")).alias("graph_ui"))


def parent_ids(chunks: DataFrame, filing: str, order: list[str], least_words: int = 20) -> DataFrame:
    """chunks with more than least_words words, numbered from 1 within each filing, and the id filing#number."""
    kept = chunks.filter(n_words(F.col("parent_chunk")) > least_words)
    n = F.row_number().over(Window.partitionBy(filing).orderBy(*order))
    return kept.withColumn("n", n).withColumn("parent_id", F.concat(F.col(filing), F.lit("#"), F.col("n").cast("string")))
