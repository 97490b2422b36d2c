"""Named queries over the test tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import periods
from quarrylens.functions.scalars import finite, percent_display, two_decimals
from quarrylens.operators import audit, chunking, context, graph, memory, queryplan, scoring, search, timeseries
from quarrylens.plans import inputs
from quarrylens.session import staged
from quarrylens.sources.html import html_elements
from quarrylens.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ONE = "NATION_7"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def csv(c) -> F.Column:
    """An array as text, so that results compare across engines."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- tables of metrics --------------------------------------------------------------------------------------------------


@query
def chart_quarterly_series(spark, d):
    s = inputs.stocks(spark, d)
    return s.select("timeframe", F.date_format("date", "yyyy-MM-dd").alias("date"), "company", "variable", F.round(finite(F.col("value")), 4).alias("value"))


@query
def chart_monthly_series(spark, d):
    s = inputs.stocks(spark, d, "monthly")
    return s.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "company", "variable", F.round("value", 4).alias("value"))


def _bars(spark, d, timeframe):
    s = inputs.stocks(spark, d, timeframe)
    return s.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "company", "variable", F.round("value", 4).alias("value"))


@query
def chart_daily_series(spark, d):
    return _bars(spark, d, "daily")


@query
def chart_weekly_series(spark, d):
    return _bars(spark, d, "weekly")


@query
def chart_yearly_series(spark, d):
    return _bars(spark, d, "yearly")


@query
def key_fallback(spark, d):
    """A metric's own column for the company, else the metric's; null for neither."""
    w = inputs.stocks(spark, d, "yearly").filter("variable IN ('Open', 'Close')").groupBy("company", "date").pivot("variable", ["Open", "Close"]).agg(F.first("value"))
    w = w.withColumnsRenamed({"Open": "Open|NATION_7", "Close": "Close"})
    first = lambda m: F.round(timeseries.first_present(w, m, ONE), 4)
    return w.select("company", F.date_format("date", "yyyy-MM-dd").alias("date"), first("Open").alias("open"), first("Close").alias("close"), first("Volume").alias("volume"))


@query
def chart_skip_missing_variable(spark, d):
    return timeseries.chart(inputs.stocks(spark, d), ONE, ["Volume", "Nothing", "Close"])


@query
def chart_candlestick(spark, d):
    c = timeseries.candles(inputs.stocks(spark, d), ONE, ["Open", "High", "Low", "Close"])
    return c.select("x", "name", *[F.col("y")[i].alias(n) for i, n in enumerate(("o", "h", "l", "c"))])


@query
def ratios_reindex(spark, d):
    return timeseries.reindexed(inputs.ratios(spark, d), ONE, ["Gross Margin", "No Such Metric", "Cash Ratio"])


@query
def ratios_period_pivot(spark, d):
    cols = [f"{y}Q{q}" for y in range(1995, 2002) for q in range(1, 5)]
    t = timeseries.ratio_table(inputs.ratios(spark, d), ONE, columns=cols)
    return t.select("metric", *[F.col(c).alias(f"p_{c}") for c in cols])


@query
def performance_point(spark, d):
    return timeseries.at_period(inputs.ratios(spark, d), None, "Q3_1996")


@query
def period_codes(spark, d):
    t = inputs.transcripts(spark, d).select("period").distinct()
    f = inputs.filings(spark, d).select("period").distinct()
    p = F.col("period")
    return t.union(f).filter("period IS NOT NULL").distinct().select(p, periods.to_code(p).alias("code"), periods.sort_key(p).alias("sort_key"), F.date_format(periods.start_date(p), "yyyy-MM-dd").alias("starts"))


@query
def nonfinite_sanitize(spark, d):
    li = read_table(spark, d, "lineitem")
    raw = F.expr("CASE l_linenumber WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN 'no number' ELSE CAST(l_quantity AS STRING) END")
    return li.select("l_linenumber", finite(raw).alias("v")).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("v").alias("n_finite"), F.round(F.sum("v"), 2).alias("total"))


@query
def metric_direction_and_transform(spark, d):
    return scoring.adjusted(inputs.ratios(spark, d)).select("company", "period", "metric", "good", F.round("adj", 6).alias("adj"))


@query
def metric_direction_override(spark, d):
    r = scoring.adjusted(inputs.ratios(spark, d), {"Current Ratio": False, "Price-to-Book": True})
    return r.select("company", "period", "metric", "good", F.round("adj", 6).alias("adj"))


@query
def risk_scores_no_peers(spark, d):
    return scoring.scores_without_peers(inputs.ratios(spark, d))


@query
def risk_scores_peers_percentile(spark, d):
    return scoring.scores_with_peers(inputs.ratios(spark, d), method="percentile")


@query
def risk_scores_peer_table(spark, d):
    """A peer table of one's own that has three metrics, and of the early periods only."""
    r = inputs.ratios(spark, d)
    of = r.filter(F.col("metric").isin("Gross Margin", "Current Ratio", "Price-to-Book") & (F.left("period", F.lit(4)).cast("int") < 1996))
    return scoring.scores_with_peers(r, of.select("period", "metric", "value"))


@query
def risk_scores_peers_minmax(spark, d):
    return scoring.scores_with_peers(inputs.ratios(spark, d), method="minmax")


@query
def risk_scores_peers_zscore(spark, d):
    return scoring.scores_with_peers(inputs.ratios(spark, d), method="zscore")


@query
def risk_point_lookup(spark, d):
    """The scores of one company at its last period, a row for every category."""
    r = inputs.ratios(spark, d)
    last = r.filter(F.col("company") == ONE).agg(F.max("period").alias("p")).first().p
    p = timeseries.point(r, ONE, last).select(F.lit(ONE).alias("company"), F.lit(last).alias("period"), "metric", "value")
    return scoring.with_gaps(scoring.scores_without_peers(p)).select("category", "n_metrics", "score", "risk")


@query
def metric_average_rank(spark, d):
    r = scoring.average_rank(inputs.ratios(spark, d), ["period", "metric"], "value")
    return r.select("company", "period", "metric", F.round("rank", 1).alias("rank"))


@query
def display_format(spark, d):
    r = inputs.ratios(spark, d)
    return r.select("company", "period", "metric", two_decimals(F.col("value")).alias("shown"), percent_display(F.col("value")).alias("percent"))


@query
def price_returns(spark, d):
    r = timeseries.returns(inputs.stocks(spark, d))
    return r.select("company", F.date_format("date", "yyyy-MM-dd").alias("date"), *[F.round(c, 6).alias(c.lower().replace(" ", "_")) for c in ("Return", "Cumulative Return", "Volatility")])


# ---- graph --------------------------------------------------------------------------------------------------------------


@query
def filing_periods(spark, d):
    return inputs.filings(spark, d).select("accession", "company", "form", F.date_format("date", "yyyy-MM-dd").alias("date"), "period")


@query
def filings_after_year(spark, d):
    return inputs.filings(spark, d).filter(F.year("date") > 2015).groupBy("company", "form").agg(F.count("*").alias("n"))


@query
def filing_next_edges(spark, d):
    return graph.next_edges(graph.filing_chain(inputs.filings(spark, d)))


def _calls(spark, d):
    return inputs.transcripts(spark, d).select(F.col("transcript_id").alias("id"), "company", "period").distinct()


@query
def transcript_next_chronological(spark, d):
    return graph.transcript_chain(_calls(spark, d))


@query
def transcript_next_lexicographic(spark, d):
    return graph.transcript_chain(_calls(spark, d), compat=True)


@query
def graph_nodes_edges(spark, d):
    """Nodes and edges by label with a sum over hashes of keys stands for the tables themselves: (label, n, distinct src)."""
    g = graph.sec_graph(inputs.chunks(spark, d, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks"), inputs.filings(spark, d))
    key = {"company": "name", "filing": "accession", "heading": "name", "parent_chunk": "chunk_id", "child_chunk": "chunk_id"}
    parts = [df.select(F.lit(n).alias("label"), F.col(key.get(n, "src")).alias("k")) for n, df in g.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"), F.min("k").alias("least"), F.max("k").alias("most"))


@query
def graph_section_edges(spark, d):
    c = inputs.chunks(spark, d, "accession_no", "item_heading")
    h = F.coalesce("item_heading", F.lit(graph.NO_HEADING))
    return graph.merge_edges(c, F.col("accession_no"), F.concat_ws("|", h, "accession_no"))


@query
def transcript_filing_match(spark, d):
    t = graph.transcripts_with_filing(inputs.transcripts(spark, d), inputs.filings(spark, d))
    return t.select("chunk_id", "company", "period", "transcript_id")


@query
def transcript_speakers(spark, d):
    t = inputs.transcripts(spark, d)
    return t.groupBy("company", F.coalesce("speaker", F.lit("N/A")).alias("speaker"), F.coalesce(F.nullif("title", F.lit("")), F.lit("N/A")).alias("title")).agg(F.count("*").alias("n"))


def _hierarchy(spark, d):
    c = inputs.chunks(spark, d, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks")
    return graph.sec_hierarchy(c, inputs.filings(spark, d))


def _parents(spark, d):
    c = inputs.chunks(spark, d, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks")
    return graph.sec_parents(c, inputs.filings(spark, d))


@query
def hierarchy_filter(spark, d):
    h = _hierarchy(spark, d).filter(graph.matches("inc", forms=["10-Q"], headings=["risk factors", "legal"]))
    return h.select("company", "accession", "form", "period", "heading", "parent_id", "child_id")


@query
def change_detection(spark, d):
    """The busiest company's 10-Q chain between two of its labels, found by the data."""
    chain = graph.filing_chain(inputs.filings(spark, d))
    top = chain.filter("form = '10-Q'").groupBy("company").count().orderBy(F.desc("count"), "company").first()
    own = chain.filter((F.col("company") == top["company"]) & (F.col("form") == "10-Q")).agg(F.min_by("period", "seq").alias("a"), F.max_by("period", "seq").alias("z")).first()
    w = graph.change_walk(_parents(spark, d), chain, top["company"], own.a, own.z, ["risk factors"])
    return w.select("company", "period", F.col("seq").cast("long").alias("seq"), "accession", "form", "heading", "parent_id", "sub_heading")


@query
def change_records(spark, d):
    """Every parent on the 10-Q chain of each company's first to last label, in order of time, as records with their path."""
    chain = graph.filing_chain(inputs.filings(spark, d)).filter("form = '10-Q'").select("accession", "seq")
    walk = _parents(spark, d).join(chain, "accession").filter(F.contains(F.lower("heading"), F.lit("risk factors")))
    r = graph.record(walk, graph.CHANGE_FIELDS, graph.CHANGE_PATH, ["FILED", "HAS_SECTION", "HAS_CONTENT"])
    place = F.row_number().over(Window.partitionBy("company").orderBy("seq", "heading", "parent_id"))
    c = lambda n: F.col("content")[n].alias(n)
    nodes = F.array_join(F.transform("graph_ui.nodes", lambda n: F.concat(n["labels"][0], F.lit("="), n["props"]["key"])), ";")
    r = r.select("seq", c("company"), c("period"), c("heading"), c("parent_id"), c("sub_heading"), nodes.alias("nodes"), F.array_join(F.transform("graph_ui.rels", lambda x: x["type"]), ">").alias("rels"))
    return r.withColumn("place", place.cast("long")).drop("seq")


@query
def change_detection_bounds(spark, d):
    """First and last period of each conversation turn's labels, in time and by text."""
    t = inputs.turns(spark, d, "parsed_metadata").filter("parsed_metadata IS NOT NULL")
    lab = periods.labels(F.col("parsed_metadata.years"), F.col("parsed_metadata.quarters"))
    t = t.select("id", lab.alias("labels"))
    a, z = graph.period_bounds(F.col("labels"))
    ca, cz = graph.period_bounds(F.col("labels"), compat=True)
    return t.select("id", csv(F.col("labels")).alias("labels"), a.alias("first"), z.alias("last"), ca.alias("first_text"), cz.alias("last_text"))


@query
def embedding_lookup(spark, d):
    c = inputs.chunks(spark, d, "form", "child_chunks").select("form", F.explode("child_chunks").alias("chunk_id", "content"))
    v = read_table(spark, d, "chunk_embeddings")
    found, missing = graph.embedding_check(c, v)
    rows = found.select("form", F.lit(True).alias("has_vector")).unionByName(missing.select("form", F.lit(False).alias("has_vector")))
    return rows.groupBy("form", "has_vector").agg(F.count("*").alias("n"))


@query
def parent_numbers(spark, d):
    c = inputs.chunks(spark, d, "accession_no", "parent_chunk")
    p = graph.parent_ids(c, "accession_no", ["chunk_id"])
    return p.select("chunk_id", F.col("n").cast("long").alias("n"), "parent_id")


# ---- search -------------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    return list(_vectors(spark, d).filter(F.col("id") == vec_id).select("embedding").first()[0])


def _six(df, *cols):
    return df.select(*cols, F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query
def vector_topk_exact(spark, d):
    return _six(search.top_k(_vectors(spark, d), _query_vector(spark, d), 10), "id", "label")


@query
def vector_topk_postfilter(spark, d):
    return _six(search.filtered_top_k(_vectors(spark, d), _query_vector(spark, d), 10, F.col("label") == 3, "post", 300), "id", "label")


@query
def vector_topk_prefilter(spark, d):
    return _six(search.filtered_top_k(_vectors(spark, d), _query_vector(spark, d), 10, F.col("label") == 3, "pre"), "id", "label")


@query
def vector_topk_allowed(spark, d):
    v = _vectors(spark, d)
    allowed = v.filter("label IN (1, 2)").select("id", F.col("label").alias("group"))
    return _six(search.allowed_top_k(v.select("id", "embedding"), allowed, _query_vector(spark, d), 5), "id", "group")


@query
def multi_query_topk_union(spark, d):
    """Ten jobs, one a label: the label's first vector asks for the three nearest of its own label."""
    v = _vectors(spark, d)
    jobs = v.groupBy("label").agg(F.min_by("embedding", "id").alias("q_vec"), F.min("id").alias("q_id")).select(F.col("label").alias("job_id"), "q_vec", "q_id")
    hits = search.jobs_top_k(v, jobs, (F.col("label") == F.col("job_id")) & (F.col("id") != F.col("q_id")), 3)
    return hits.select("job_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _call_vectors(spark, d):
    """Calls, their children or the whole text, with a vector."""
    t = inputs.transcripts(spark, d)
    kids = graph.transcript_hierarchy(t)
    whole = t.select("company", "period", "transcript_id", "speaker", F.nullif("title", F.lit("")).alias("title"), F.col("chunk_id").alias("parent_id"), F.col("chunk").alias("parent_text"), F.col("chunk_id").alias("child_id"), F.col("chunk").alias("child_text"))
    v = read_table(spark, d, "chunk_embeddings").filter("id IS NOT NULL").select(F.col("id").alias("child_id"), F.col("openai_embedding").alias("embedding")).distinct()
    return kids.unionByName(whole).join(v, "child_id")


def _first_ask(spark, d, column):
    """The vector of the first turn that has one."""
    t = inputs.turns(spark, d, column).filter(F.size(column) == 128)
    return list(t.orderBy("id").select(column).first()[0])


@query
def transcript_topk(spark, d):
    """The five nearest pieces of calls of the last years, out of the 150 nearest of all."""
    near = search.filtered_top_k(_call_vectors(spark, d), _first_ask(spark, d, "embedding_trans"), 5, F.right("period", F.lit(4)).try_cast("int") >= 2010, "post", 150, "child_id")
    return near.select("child_id", "company", "period", F.coalesce("speaker", F.lit("N/A")).alias("speaker"), F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


@query
def transcript_records(spark, d):
    """The same hits as records with the path that leads to them."""
    near = search.filtered_top_k(_call_vectors(spark, d), _first_ask(spark, d, "embedding_trans"), 5, F.lit(True), "post", 150, "child_id")
    r = graph.record(near, graph.TRANSCRIPT_FIELDS, graph.TRANSCRIPT_PATH, ["HOSTED", "HAS_CONTENT", "HAS_CHILD"])
    c = F.col("content")
    return r.select(c["child_id"].alias("child_id"), F.md5(c["parent_text"]).alias("digest"), c["transcript_id"].alias("transcript_id"), F.round(c["score"], 6).alias("score"), F.array_join(F.transform("graph_ui.nodes", lambda n: F.concat(n["labels"][0], F.lit("="), n["props"]["key"])), ";").alias("nodes"), F.array_join(F.transform("graph_ui.rels", lambda x: x["type"]), ">").alias("rels"))


@query
def multi_query_budgets(spark, d):
    """For every turn with both vectors: three pieces of its first company's filings out of the ten nearest, and two of its calls
    out of the five nearest, by the words they share with the question."""
    t = inputs.turns(spark, d, "modif_query", "parsed_metadata", "embedding", "embedding_trans")
    t = t.select(F.col("id").alias("job_id"), F.col("modif_query").alias("q"), F.try_element_at(F.col("parsed_metadata.companies"), F.lit(1))["name"].alias("who"), "embedding", "embedding_trans")
    t = t.filter("q IS NOT NULL AND who IS NOT NULL AND size(embedding) = 128 AND size(embedding_trans) = 128")
    h = _hierarchy(spark, d).select("company", "child_id", "child_text", "parent_text")
    p = _parents(spark, d).select("company", F.col("parent_id").alias("child_id"), F.col("parent_text").alias("child_text"), "parent_text")
    v = read_table(spark, d, "chunk_embeddings").filter("id IS NOT NULL").select(F.col("id").alias("child_id"), F.col("openai_embedding").alias("vec")).distinct()
    v = v.filter(~F.exists("vec", F.isnan))
    sec = h.unionByName(p).join(v, "child_id").select("company", "child_id", "vec", "parent_text")
    call = _call_vectors(spark, d).select("company", "child_id", F.col("embedding").alias("vec"), F.col("child_text").alias("parent_text"))
    call = call.filter(~F.exists("vec", F.isnan))
    t, out = staged(t, "asks"), None
    for source, pool, ask, k, budget in (("filings", sec, "embedding", 10, 3), ("calls", call, "embedding_trans", 5, 2)):
        # the search moves ids and vectors only; the texts of what it has found are joined by the row's hash
        pool = staged(pool.withColumn("row", F.xxhash64(*pool.columns)), "pool")
        near = staged(search.grouped_top_k(pool, t, "company", "who", k, "child_id", "vec", ask, ["row"]).filter(~F.isnan("score")), "near")  # infinite values take a place, as in SQL, and are no hits
        texts = pool.join(near.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.min("parent_text").alias("parent_text"))
        hits = near.join(texts, "row").join(t.select("job_id", "q"), "job_id").withColumn("id", F.col("child_id"))
        best = search.rerank(hits, budget, by=["job_id"]).select("job_id", F.lit(source).alias("source"), "child_id", F.col("rerank").cast("long").alias("place"))
        out = best if out is None else out.unionByName(best)
    return out


@query
def transcript_rerank_lexical(spark, d):
    """For each company the transcript children that share most words with a fixed question."""
    h = graph.transcript_hierarchy(inputs.transcripts(spark, d))
    h = h.select("company", "period", "child_id", F.col("child_id").alias("id"), F.lit("operating margin and revenue outlook for the next quarter").alias("q"), "child_text", F.lit(1.0).alias("score"))
    r = search.rerank(h, 5, text="child_text", by=["company"])
    return r.select("company", "period", "child_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank").cast("long").alias("rerank"))


def _cited(spark, d):
    t = inputs.turns(spark, d, "conversation_id", "turn_id", "modif_query", "sec_context").filter("modif_query IS NOT NULL")
    c = t.select(F.col("id").alias("turn"), F.col("modif_query").alias("q"), F.posexplode("sec_context").alias("pos", "c"))
    return c.select("turn", "q", "pos", F.col("c.child_chunk_id").alias("child_id"), F.col("c.score").alias("score"))


@query
def dedupe_first(spark, d):
    return search.keep_first(_cited(spark, d), "child_id", ["pos"], by=["turn"]).select("turn", "child_id", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


@query
def dedupe_first_overall(spark, d):
    return search.keep_first(_cited(spark, d), "child_id", ["turn", "pos"]).select("child_id", "turn", F.col("pos").cast("long").alias("pos"))


def _cited_texts(spark, d):
    """Each turn's cited chunks with their texts: a child, or a parent that was kept whole."""
    ids = _cited(spark, d).filter("child_id IS NOT NULL")
    only = ids.select(F.regexp_replace("child_id", "_[0-9]+$", "").alias("chunk_id")).union(ids.select("child_id")).distinct()
    c = inputs.chunks(spark, d, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks", only=only)
    p = graph.sec_parents(c, inputs.filings(spark, d))
    kids = p.select("company", "period", "form", "heading", "accession", "sub_heading", "parent_text", F.explode("children").alias("child_id", "child_text"))
    whole = p.select("company", "period", "form", "heading", "accession", "sub_heading", "parent_text", F.col("parent_id").alias("child_id"), F.col("parent_text").alias("child_text"))
    first = search.keep_first(_cited(spark, d), "child_id", ["pos"], by=["turn"])
    return first.join(kids.unionByName(whole), "child_id").withColumn("id", F.col("child_id"))


@query
def rerank_lexical(spark, d):
    r = search.rerank(_cited_texts(spark, d), 3, by=["turn"])
    return r.select("turn", "child_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank").cast("long").alias("rerank"))


@query
def evidence_context(spark, d):
    r = search.rerank(_cited_texts(spark, d), 3, by=["turn"])
    c = context.assemble(r, context.sec_block(), ["turn"], "rerank")
    return c.select("turn", "n_blocks", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


@query
def transcript_context(spark, d):
    h = inputs.transcripts(spark, d).withColumn("parent_text", F.col("chunk"))
    c = context.assemble(h, context.transcript_block(), ["transcript_id"], "chunk_id")
    return c.select("transcript_id", "n_blocks", F.md5("context").alias("digest"))


@query
def retrieval_record_struct(spark, d):
    h = _hierarchy(spark, d).withColumn("score", F.lit(1.0))
    path = [("Company", "company"), ("Filing", "accession"), ("Heading", "heading"), ("ParentChunk", "parent_id"), ("ChildChunk", "child_id")]
    r = graph.record(h, graph.SEC_FIELDS, path, ["FILED", "HAS_SECTION", "HAS_CONTENT", "HAS_CHILD"])
    return r.select(
        F.col("content.child_id").alias("child_id"), F.col("content.company").alias("company"), F.col("content.sub_heading").alias("sub_heading"), F.size("graph_ui.nodes").alias("n_nodes"),
        F.array_join(F.transform("graph_ui.nodes", lambda n: F.concat(n["labels"][0], F.lit("="), n["props"]["key"])), ";").alias("nodes"), F.array_join(F.transform("graph_ui.rels", lambda r: r["type"]), ">").alias("rels"),
    )


@query
def turn_envelopes(spark, d):
    t = inputs.turns(spark, d, "modif_query", "parsed_metadata").filter("modif_query IS NOT NULL")
    who = F.try_element_at(F.col("parsed_metadata.companies"), F.lit(1))["name"]
    lab = F.try_element_at(periods.labels(F.col("parsed_metadata.years"), F.col("parsed_metadata.quarters")), F.lit(1))
    return t.select("id", context.turn_envelope(F.coalesce(who, F.lit("N/A")), F.coalesce(lab, F.lit("N/A")), F.col("modif_query")).alias("text"))


# ---- chunking -----------------------------------------------------------------------------------------------------------


@query
def child_chunk_windows(spark, d):
    w = chunking.windows(read_table(spark, d, "documents"), "doc_id", "text", 120, 30)
    return w.select(F.col("id").alias("doc_id"), F.col("piece_no").cast("long").alias("piece_no"), F.col("n_words").cast("long").alias("n_words"), F.md5("piece").alias("digest"))


@query
def child_chunk_fold(spark, d):
    w = chunking.windows(read_table(spark, d, "documents"), "doc_id", "text", 120, 0)
    g = w.groupBy("id").agg(F.sum("n_words").alias("words"), F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))), lambda x: x["piece"]).alias("pieces"))
    k = g.select("id", "words", F.size("pieces").alias("n_pieces"), F.explode(chunking.fold_children(F.col("words"), F.col("pieces"))).alias("c"))
    from quarrylens.functions.scalars import n_words

    return k.select(F.col("id").alias("doc_id"), F.col("n_pieces").cast("long").alias("n_pieces"), F.col("c.key").cast("long").alias("key"), n_words(F.col("c.text")).cast("long").alias("n_words"))


@query
def page_furniture(spark, d):
    t = read_table(spark, d, "documents").filter("text IS NOT NULL")
    lines = t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(chunking.is_footer(F.col("line")) | chunking.is_skipped_header(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def _elements(spark, d):
    """Headers and bodies of each filing's chunks in their order, as a parser of the filing would give them."""
    c = inputs.chunks(spark, d, "accession_no", "form", "item_heading", "is_table", "sub_headings", "parent_chunk").filter("parent_chunk IS NOT NULL").withColumn("item_heading", F.coalesce("item_heading", F.lit(graph.NO_HEADING)))
    heads = F.coalesce(F.transform(F.array_sort(F.map_entries("sub_headings")), lambda e: F.struct(F.lit("text").alias("kind"), F.lit(True).alias("is_header"), e["value"].alias("text"))), F.array().cast("array<struct<kind:string,is_header:boolean,text:string>>"))
    body = F.array(F.struct(F.when(F.col("is_table"), "table").otherwise("text").alias("kind"), F.lit(False).alias("is_header"), F.col("parent_chunk").alias("text")))
    n = F.element_at(F.split("chunk_id", "#"), -1).cast("int")
    e = c.select(F.col("accession_no").alias("doc_id"), "form", F.split("item_heading", ":")[0].alias("item"), n.alias("n"), F.posexplode(F.concat(heads, body)).alias("k", "e"))
    return e.select("doc_id", "form", "item", (F.col("n") * 100 + F.col("k")).alias("seq"), "e.*")


@query
def chunk_state_machine(spark, d):
    return chunking.chunk_filings(_elements(spark, d)).select("chunk_id", "form", "item", "is_table", F.size("sub_headings").alias("n_levels"), F.length("parent_chunk").alias("n_chars"))


@query
def html_blocks_headers(spark, d):
    c = inputs.chunks(spark, d, "item_heading", "is_table", "parent_chunk").filter("parent_chunk IS NOT NULL")
    esc = lambda x: F.regexp_replace(F.regexp_replace(x, "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<html><body><h2>"), esc(F.coalesce("item_heading", F.lit("-"))), F.lit("</h2><p>"), esc(F.col("parent_chunk")), F.lit("</p></body></html>"))
    e = html_elements(c.select(F.col("chunk_id").alias("doc_id"), page.alias("html")))
    return e.groupBy("kind", "is_header").agg(F.count("*").alias("n"))


@query
def chunk_10q_items(spark, d):
    """The machine over each part of every 10-Q: headers that hold an item's heading switch to it. Texts in plain characters."""
    c = inputs.chunks(spark, d, "accession_no", "form", "item_heading", "part_heading", "parent_chunk")
    c = c.filter("form = '10-Q' AND item_heading IS NOT NULL AND part_heading IS NOT NULL AND parent_chunk IS NOT NULL")
    plain = lambda x: F.trim(F.regexp_replace(x, "[^!-~]+", " "))
    n = F.element_at(F.split("chunk_id", "#"), -1).cast("int")
    two = F.array(F.struct(F.lit(True).alias("is_header"), plain(F.col("item_heading")).alias("text")), F.struct(F.lit(False).alias("is_header"), plain(F.col("parent_chunk")).alias("text")))
    e = c.select(F.col("accession_no").alias("doc_id"), "form", F.col("part_heading").alias("part"), F.split("item_heading", ":")[0].alias("item"), n.alias("n"), F.posexplode(two).alias("k", "e"))
    e = e.select("doc_id", "form", "part", "item", (F.col("n") * 2 + F.col("k")).alias("seq"), F.lit("text").alias("kind"), "e.*")
    toc = toc_item_headings_10q(spark, d)
    m = chunking.chunk_filings(e, item_headings=toc)
    return m.select("doc_id", "part", "item", F.md5("parent_chunk").alias("digest"))


@query
def contents_found(spark, d):
    """For each 10-K the first of its chunks, as tables, that holds the first third of its items."""
    c = inputs.chunks(spark, d, "accession_no", "form", "item_heading", "parent_chunk").filter("form = '10-K'")
    item = F.lower(F.split("item_heading", ":")[0])
    items = c.filter("item_heading IS NOT NULL").groupBy(F.col("accession_no").alias("doc_id")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    own = c.filter("item_heading IS NOT NULL").select(F.col("accession_no").alias("doc_id"), F.element_at(F.split("chunk_id", "#"), -1).cast("int").alias("table_no"), F.lower("item_heading").alias("text"))
    rows = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    upto = own.withColumn("text", F.concat_ws(" | ", F.collect_list("text").over(rows)))
    return chunking.contents_tables(upto, items).select("doc_id", F.col("table_no").cast("long").alias("table_no"))


@query
def accepted_tables(spark, d):
    c = inputs.chunks(spark, d, "is_table", "parent_chunk").filter("parent_chunk IS NOT NULL")
    return c.groupBy("is_table", chunking.accepted_table(F.col("parent_chunk"), 2).alias("accepted")).agg(F.count("*").alias("n"))


def _contents(spark, d, form):
    c = inputs.chunks(spark, d, "accession_no", "form", "item_heading", "part_heading").filter((F.col("form") == form) & F.col("item_heading").isNotNull())
    return c.select(F.col("accession_no").alias("doc_id"), "part_heading", F.split("item_heading", ":")[0].alias("item"), F.trim(F.split("item_heading", ":")[1]).alias("heading")).distinct()


@query
def toc_item_headings_10k(spark, d):
    t = _contents(spark, d, "10-K")
    toc = t.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("item", "heading")).alias("row"), F.concat(F.upper("item"), F.lit(". ")).alias("index_text"), "heading")
    return chunking.item_headings_10k(t.select("doc_id", "item").distinct(), toc)


@query
def toc_item_headings_10q(spark, d):
    t = _contents(spark, d, "10-Q").filter("part_heading IS NOT NULL")
    rows = t.select("doc_id", F.col("part_heading").alias("p"), F.lit(1).alias("o"), F.concat("item", F.lit(".")).alias("index_text"), "heading")
    parts = t.select("doc_id", F.col("part_heading").alias("p"), F.lit(0).alias("o"), F.concat(F.upper("part_heading"), F.lit(".")).alias("index_text"), F.lit("").alias("heading")).distinct()
    w = Window.partitionBy("doc_id").orderBy("p", "o", "index_text", "heading")
    toc = rows.unionByName(parts).withColumn("row", F.row_number().over(w))
    return chunking.item_headings_10q(toc)


# ---- questions ----------------------------------------------------------------------------------------------------------


def _questions(spark, d):
    return inputs.turns(spark, d, "modif_query").filter("modif_query IS NOT NULL").select(F.col("id").alias("q_id"), F.col("modif_query").alias("q"))


def _parsed(spark, d):
    p = queryplan.parsed(_questions(spark, d), read_table(spark, d, "companies"))
    return p.withColumn("query_type", queryplan.query_type(F.col("q"), F.col("tickers"), F.col("years")))


@query
def query_parse(spark, d):
    p = _parsed(spark, d).withColumn("labels", periods.labels(F.col("years"), F.col("quarters")))
    lab = F.col("labels")
    return p.select("q_id", csv(F.col("tickers")).alias("tickers"), csv(F.col("years")).alias("years"), csv(F.col("quarters")).alias("quarters"), "filing_type_hint", csv(F.col("section_hints")).alias("section_hints"), csv(lab).alias("periods"))


@query
def query_classes(spark, d):
    return _parsed(spark, d).select("q_id", "query_type", queryplan.source(F.col("q")).alias("source"), audit.retriever(F.col("query_type")).alias("retriever"))


@query
def tone_focus(spark, d):
    focus, ask = queryplan.tone(F.col("q"))
    return _questions(spark, d).select("q_id", focus.alias("focus"), ask.alias("tone_query"))


@query
def subquery_validate(spark, d):
    t = inputs.turns(spark, d, "modif_query", "transcript_query").filter("modif_query IS NOT NULL")
    raw = F.array(F.col("modif_query"), F.concat(F.lit("  "), F.upper("modif_query")), F.col("transcript_query"), F.lit(" "), F.concat_ws("   ", "transcript_query", "id"))
    return t.select("id", F.array_join(queryplan.valid_sub_queries(raw, F.col("modif_query")), "|").alias("sub_queries"))


@query
def retrieval_jobs(spark, d):
    j = queryplan.retrieval_jobs(_parsed(spark, d), read_table(spark, d, "companies"))
    return j.select("q_id", "job_no", "q", "ticker", csv(F.col("periods")).alias("periods"), csv(F.col("forms")).alias("forms"), csv(F.col("headings")).alias("headings"))


@query
def history_fill(spark, d):
    t = inputs.turns(spark, d, "conversation_id", "turn_id", "parsed_metadata")
    t = t.select("id", "conversation_id", "turn_id", F.try_element_at(F.col("parsed_metadata.companies"), F.lit(1))["ticker"].alias("ticker"), F.try_element_at(F.col("parsed_metadata.years"), F.lit(1)).alias("year"))
    f = queryplan.filled_from_history(t, ["ticker", "year"])
    return f.select("id", "ticker_filled", "year_filled")


# ---- memory and gates ---------------------------------------------------------------------------------------------------


@query
def memory_upsert_latest(spark, d):
    t = read_table(spark, d, "conversation_turns").select("id", "conversation_id", "turn_id", "query_type", "asked_at")
    return memory.upserted(t.filter("turn_id < 5"), t.filter("turn_id >= 3")).select("id", "conversation_id", "turn_id", "query_type", F.date_format("asked_at", "yyyy-MM-dd HH:mm:ss").alias("asked_at"))


@query
def memory_next_turn(spark, d):
    return memory.next_turn(read_table(spark, d, "conversation_turns"))


@query
def memory_last_turns(spark, d):
    return memory.last_turns(inputs.turns(spark, d, "conversation_id", "turn_id")).select("id", "conversation_id", "turn_id", F.col("place").cast("long").alias("place"))


@query
def context_reuse(spark, d):
    t = inputs.turns(spark, d, "conversation_id", "turn_id", "parsed_metadata", "embedding")
    return memory.reusable(t, 0.2, 0.0).select("id", "reuse_id", F.round("sim", 6).alias("sim"))


@query
def context_reuse_strict(spark, d):
    """With the production thresholds; few turns ask the same thing twice."""
    return memory.reusable(inputs.turns(spark, d, "conversation_id", "turn_id", "parsed_metadata", "embedding")).select("id", "reuse_id")


@query
def context_reuse_again(spark, d):
    """With the production thresholds, every turn asked again at the end of its conversation."""
    t = inputs.turns(spark, d, "conversation_id", "turn_id", "parsed_metadata", "embedding")
    again = t.select(F.concat("id", F.lit("+")).alias("id"), "conversation_id", (F.col("turn_id") + 1000).alias("turn_id"), "parsed_metadata", "embedding")
    return memory.reusable(t.select(*again.columns).unionByName(again)).select("id", "reuse_id", F.round("sim", 6).alias("sim"))


@query
def conversation_scan(spark, d):
    """The first conversation with its empty fields filled."""
    t = inputs.turns(spark, d, "conversation_id", "turn_id", "modif_query", "sec_context", "trans_context", "embedding", "embedding_trans")
    first = t.filter("modif_query IS NOT NULL").agg(F.min("conversation_id").alias("c")).first().c
    return memory.conversation(t, first).select("id", "turn_id", "modif_query", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("sec_context", "trans_context", "embedding", "embedding_trans")])


@query
def safety_gate(spark, d):
    t = inputs.turns(spark, d, "modif_query", "llm_response_sec")
    q, a = F.col("modif_query"), F.col("llm_response_sec")
    return t.select("id", audit.harmful(q).alias("harmful"), audit.input_class(q).alias("input_class"), audit.input_fails(q).alias("input_fails"), audit.output_fails(a).alias("output_fails"))


def _audited(spark, d):
    t = inputs.turns(spark, d, "modif_query", "llm_response_sec", "turn_id", "parsed_metadata")
    r = search.rerank(_cited_texts(spark, d), 3, by=["turn"])
    ctx = r.groupBy("turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rerank", "parent_text"))), lambda x: x["parent_text"]), " ").alias("ctx"), F.count("*").alias("n_hits"))
    j = t.join(ctx.withColumnRenamed("turn", "id"), "id", "left")
    return j.withColumns({"faith": audit.faithfulness(F.col("llm_response_sec"), F.col("ctx")), "rel": audit.relevancy(F.col("modif_query"), F.col("llm_response_sec"))})


@query
def audit_scores(spark, d):
    return _audited(spark, d).select("id", F.round("faith", 6).alias("faithfulness"), F.round("rel", 6).alias("relevancy"), audit.passes(F.col("faith"), F.col("rel")).alias("analysis_ok"))


@query
def route_decision(spark, d):
    a = _audited(spark, d).withColumns({"ok": audit.passes(F.col("faith"), F.col("rel")), "enough": audit.sufficient(F.col("n_hits")), "in_bad": audit.input_fails(F.col("modif_query")), "out_bad": audit.output_fails(F.col("llm_response_sec"))})
    m = F.col("parsed_metadata")
    n = F.coalesce(F.size(m["companies"]), F.lit(0))
    retries = F.col("turn_id") % 4
    return a.select(
        "id", audit.needs_refinement(m["companies"], m["years"], m["quarters"]).alias("needs_refinement"), audit.after_research(F.col("enough"), retries).alias("after_research"),
        audit.after_audit(F.col("in_bad") | F.col("out_bad"), F.col("ok"), retries).alias("after_audit"),
        F.md5(F.coalesce(audit.final_text(F.col("in_bad"), F.col("out_bad"), F.col("in_bad") | F.col("out_bad"), n, ~F.col("enough") & (retries >= 3), F.col("llm_response_sec"), F.lit("")), F.lit(""))).alias("final_digest"),
    )
