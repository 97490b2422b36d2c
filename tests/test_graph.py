import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import context, graph

D = dt.date.fromisoformat
ROWS = [("A", "10-K", "k1", "2024-11-01"), ("A", "10-Q", "a1", "2024-02-01"), ("A", "10-Q", "a2", "2024-05-01"), ("A", "10-Q", "a3", "2024-08-01"), ("A", "10-Q", "a4", "2025-02-01"), ("B", "10-Q", "b1", "2024-05-03"), ("B", "10-Q", "b2", None)]


def filings(spark):
    return graph.filing_labels(spark.createDataFrame([(c, f, a, d and D(d)) for c, f, a, d in ROWS], "company string, form string, accession string, date date"))


def test_labels_and_chain(spark):
    f = filings(spark)
    assert {r.accession: r.period for r in f.collect()} == {"k1": "FY_2024", "a1": "Q1_2024", "a2": "Q2_2024", "a3": "Q3_2024", "a4": "Q1_2025", "b1": "Q1_2024", "b2": None}
    assert {tuple(r) for r in graph.next_edges(graph.filing_chain(f)).collect()} == {("a1", "a2"), ("a2", "a3"), ("a3", "a4")}


def parents(spark):
    return spark.createDataFrame([(c, a, f, "Item 1A: Risk Factors" if a != "a3" else None, a + "#1", "text") for c, f, a, _ in ROWS], "company string, accession string, form string, heading string, parent_id string, parent_text string").withColumn("sub_heading", F.lit("{}")).join(
        filings(spark).select("accession", "period"), "accession"
    )


def test_change_walk(spark):
    chain = graph.filing_chain(filings(spark))
    walk = lambda a, z, h=None: sorted(r.accession for r in graph.change_walk(parents(spark), chain, "A", a, z, h).collect())
    assert walk("Q2_2024", "Q1_2025") == ["a2", "a3", "a4"]
    assert walk("Q2_2024", "Q1_2025", ["risk"]) == ["a2", "a4"]  # a null heading meets no hint
    assert walk("Q1_2025", "Q3_2024") == [] and walk("Q1_2024", "Q9_2024") == []
    lo, hi = graph.period_bounds(F.array(F.lit("Q3_2024"), F.lit("Q1_2025")))
    clo, chi = graph.period_bounds(F.array(F.lit("Q3_2024"), F.lit("Q1_2025")), compat=True)
    assert tuple(spark.range(1).select(lo, hi, clo, chi).first()) == ("Q3_2024", "Q1_2025", "Q1_2025", "Q3_2024")


def test_transcript_chain_orders(spark):
    t = spark.createDataFrame([("t1", "A", "Q1_2024"), ("t2", "A", "Q2_2024"), ("t3", "A", "Q1_2025")], "id string, company string, period string")
    assert {tuple(r) for r in graph.transcript_chain(t).collect()} == {("t1", "t2"), ("t2", "t3")}
    assert {tuple(r) for r in graph.transcript_chain(t, compat=True).collect()} == {("t1", "t3"), ("t3", "t2")}


def test_cleaning(spark):
    co = spark.createDataFrame([("HAL", "Hal Inc."), ("FEN", "FENTOR LTD")], "ticker string, display_name string")
    f = spark.createDataFrame([("hal ", "10-q ", D("2024-01-01"), "x"), ("HAL", "10-Q", D("2024-01-02"), "x"), ("FEN", "10-K/A", None, "y"), ("ZZZ", "10-K", None, "z"), ("HAL", "10-K", None, None)], "ticker string, form string, filing_date date, accession_number string")
    assert {tuple(r) for r in graph.clean_filings(f, co).select("accession", "company", "form", "date").collect()} == {("x", "Hal Inc.", "10-Q", D("2024-01-02")), ("y", "FENTOR LTD", "10-K", None)}
    t = spark.createDataFrame([("Fentor Ltd.", 1), ("  hal inc", 2), (None, 3), ("other", 4)], "company string, n int")
    assert {tuple(r) for r in graph.named_companies(t, co).select("company", "n").collect()} == {("FENTOR LTD", 1), ("Hal Inc.", 2)}


def test_hierarchy_and_filters(spark):
    ch = spark.createDataFrame([("a1#1", "a1", None, "p", {"b": "2", "a": "1"}, False, {"a1#1_0": "c0", "a1#1_1": "c1"}), ("a2#1", "a2", "Item 2", "q", None, True, {}), ("zz#1", "zz", "Item 2", "q", None, True, None)], "chunk_id string, accession_no string, item_heading string, parent_chunk string, sub_headings map<string,string>, is_table boolean, child_chunks map<string,string>")
    h = graph.sec_hierarchy(ch, filings(spark))
    rows = h.orderBy("child_id").collect()
    assert [(r.child_id, r.heading, r.sub_heading, r.company) for r in rows] == [("a1#1_0", "Not Found", '{"a":"1","b":"2"}', "A"), ("a1#1_1", "Not Found", '{"a":"1","b":"2"}', "A")]
    assert graph.sec_parents(ch, filings(spark)).count() == 2  # parents without children are here only
    assert h.filter(graph.matches("a", ["Q1_2024"], ["10-Q"], ["found", "x"])).count() == 2
    assert h.filter(graph.matches("b")).count() == 0 and h.filter(graph.matches()).count() == 2
    g = graph.sec_graph(ch, filings(spark))
    assert g["child_chunk"].count() == 2 and g["has_child"].count() == 2 and g["parent_chunk"].count() == 3
    v = spark.createDataFrame([("a1#1_0", [1.0])], "id string, openai_embedding array<float>")
    found, missing = graph.embedding_check(g["child_chunk"], v)
    assert found.count() == 1 and [r.chunk_id for r in missing.collect()] == ["a1#1_1"]
    r = graph.record(h.withColumn("score", F.lit(0.5)), graph.SEC_FIELDS, [("Company", "company"), ("Filing", "accession")], ["FILED"]).first()
    assert r.content.score == 0.5 and r.graph_ui.nodes[0].labels == ["Company"] and r.graph_ui.rels[0].type == "FILED"


def test_parent_numbers(spark):
    df = spark.createDataFrame([("c1", "a", "w " * 30), ("c2", "a", "w " * 20), ("c3", "a", "w " * 21), ("c4", "a", None)], "chunk_id string, accession_no string, parent_chunk string")
    assert {(r.chunk_id, r.parent_id) for r in graph.parent_ids(df, "accession_no", ["chunk_id"]).collect()} == {("c1", "a#1"), ("c3", "a#2")}


def test_last_writer_wins(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "id string, seq int, v string")
    assert [r.v for r in graph.merge_nodes(df, ["id"], ["seq"]).collect()] == ["new"]
    assert graph.merge_edges(df, F.col("id"), F.col("v")).count() == 2


def test_context(spark):
    h = spark.createDataFrame([(1, 2, None, "Q1", "10-K", "h", "a1", None, " two "), (1, 1, "C", None, None, None, None, "{}", None)], "job int, n int, company string, period string, form string, heading string, accession string, sub_heading string, parent_text string")
    r = context.assemble(h, context.sec_block(), ["job"], "n").first()
    assert r.n_blocks == 2 and r.context.startswith("--- EVIDENCE ID: N/A ---\nCompany: C\nPeriod: N/A\n") and r.context.endswith("Content: two\n") and context.RULE in r.context


def test_a_missing_embedding_is_an_error(spark):
    kids = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string")
    vectors = spark.createDataFrame([("a", [1.0])], "id string, openai_embedding array<double>")
    assert graph.with_embedding(kids.filter("chunk_id = 'a'"), vectors).first().embedding == [1.0]
    with pytest.raises(Exception, match="no embedding for b"):
        graph.with_embedding(kids, vectors).collect()
