import datetime as dt

from pyspark.sql import functions as F

from quarrylens.operators import audit, graph
from quarrylens.plans import catalogue, inputs, oracle, pipeline, round_trips
from quarrylens.sources.readers import read_table
from quarrylens.streaming import turns


def test_every_oracle_has_a_query():
    assert set(oracle.ORACLE) <= set(catalogue.QUERIES) | set(round_trips.QUERIES)


def test_entry_runs(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalogue.risk_scores_no_peers(spark, data).count() > 0


def test_scores_add_up(spark, data):
    rows = catalogue.risk_scores_peers_percentile(spark, data).collect()
    assert rows and all(abs(r.score + r.risk - 100) < 1e-6 and 0 <= r.score <= 100 for r in rows)


def test_next_edges_are_chains(spark, data):
    e = catalogue.filing_next_edges(spark, data)
    assert e.groupBy("src").count().filter("count > 1").count() == 0 and e.groupBy("dst").count().filter("count > 1").count() == 0


def test_pipeline(spark, data):
    co, fil = read_table(spark, data, "companies"), inputs.filings(spark, data)
    ch = inputs.chunks(spark, data, "accession_no", "item_heading", "parent_chunk", "sub_headings", "is_table", "child_chunks")
    h, p = graph.sec_hierarchy(ch, fil).cache(), graph.sec_parents(ch, fil)
    t = pipeline.Tables(co, p, h, graph.filing_chain(fil))
    some = h.filter("period IS NOT NULL").orderBy("child_id").first()
    q = f"What were the risks at {some.company} in {some.period.replace('FY_', '')}?"
    a = pipeline.answer(t, q)
    assert a.n_hits > 0 and a.route == "accept" and some.company in a.answer
    assert pipeline.answer(t, "hello").answer == audit.TEXTS["query_harmful"]
    assert pipeline.answer(t, "revenue of Nobody Known in 2008").answer == audit.TEXTS["no_company"]


def _walk_tables(spark, n_filings=4, per=30):
    """A company with n_filings 10-Qs in 2019 and 2020, and per parents on risk factors in each, written in no order."""
    co = spark.createDataFrame([("ACM", "Acme Inc", "acme inc", ["acme"])], "ticker string, display_name string, canonical_name string, synonyms array<string>")
    fil = graph.filing_labels(spark.createDataFrame([("Acme Inc", "10-Q", f"acc{i}", dt.date(2019 + i // 3, 2 + 3 * (i % 3), 1)) for i in range(n_filings)], "company string, form string, accession string, date date"))
    ch = [(f"acc{i}", "Item 1A. Risk Factors", f"acc{i}#{j:03d}", f"Risk {i} {j}.", False, None, {f"acc{i}#{j:03d}_0": f"Risk {i} {j}."}) for j in reversed(range(per)) for i in range(n_filings)]
    ch = spark.createDataFrame(ch, "accession_no string, item_heading string, chunk_id string, parent_chunk string, is_table boolean, sub_headings map<string,string>, child_chunks map<string,string>").repartition(7)
    return pipeline.Tables(co, graph.sec_parents(ch, fil), graph.sec_hierarchy(ch, fil), graph.filing_chain(fil))


def test_change_walk_is_whole_and_in_order(spark):
    t = _walk_tables(spark)
    a = pipeline.answer(t, "How did the risk factors of Acme change from Q1 2019 to Q1 2020?")
    assert a.query_type == "CHANGE_DETECTION" and a.n_hits == 120
    assert [x for x in a.answer.splitlines() if x.startswith("Content: ")] == [f"Content: Risk {i} {j}." for i in range(4) for j in range(30)]


def test_retries_open_the_periods(spark):
    a = pipeline.answer(_walk_tables(spark, 1, 2), "What were the risk factors of Acme in Q3 2011?")
    assert (a.retries, a.n_hits) == (2, 2) and "Risk 0 1." in a.answer


def _calls(spark, n=7):
    rows = [("Acme Inc", "Q1_2019", "Acme Inc_Q1_2019", "Ann", "CEO", f"c{i}", f"Concerns and risks {i}.", f"c{i}_0", f"Concerns and risks {i}.", [1.0, float(i)]) for i in range(n)]
    rows += [("Other Inc", "Q1_2019", "Other Inc_Q1_2019", "Bob", None, "o", "Concerns.", "o_0", "Concerns.", [1.0, 0.0])]
    return spark.createDataFrame(rows, "company string, period string, transcript_id string, speaker string, title string, parent_id string, parent_text string, child_id string, child_text string, embedding array<double>")


def test_calls_have_their_budgets(spark):
    from pyspark.sql import Row

    t = _walk_tables(spark, 1, 1)
    t.transcripts, t.embed = _calls(spark), lambda q: [1.0, 0.0]
    job = lambda n: Row(job_no=n, q="risks", ticker="ACM", periods=["Q1_2019"])
    got = {ty: [r.child_id for r in pipeline.calls_of(t, [job(1), job(2)], ty, "risks").orderBy("n").collect()] for ty in ("SIMPLE", "CHANGE_DETECTION", "BROAD")}
    assert got == {"SIMPLE": [f"c{i}_0" for i in range(5)], "CHANGE_DETECTION": [f"c{i}_0" for i in range(5)], "BROAD": ["c0_0", "c1_0"] * 2}
    assert pipeline.calls_of(t, [job(1)], "GENERAL", "risks") is None


def test_gate_retries_and_commentary(spark):
    t = _walk_tables(spark, 1, 2)
    t.transcripts = _calls(spark)
    q = "What were the risk factors of Acme in Q1 2019?"
    t.hierarchy = t.hierarchy.withColumn("parent_text", F.lit(f"{q} They were small."))
    tried = []
    t.write = lambda q, sec, failed: tried.append(failed) or (q if failed == 2 else "nothing to the point")
    a = pipeline.answer(t, q)
    assert tried == [0, 1, 2] and (a.route, a.analysis_retries, a.n_hits, a.n_calls) == ("accept", 2, 2, 5) and a.relevant == 1.0
    assert a.answer.count("## From the calls") == 1 and "Other Inc" not in a.answer
    t.write = lambda q, sec, failed: "nothing to the point"
    a = pipeline.answer(t, q)
    assert (a.route, a.analysis_retries) == ("exhausted", 3) and "nothing to the point" in a.answer
    t.write = lambda q, sec, failed: "You should buy this stock."
    assert pipeline.answer(t, q).answer == audit.TEXTS["response_harmful"]


def test_history_and_reuse(spark):
    t = _walk_tables(spark, 2, 2)
    t.transcripts, t.embed = _calls(spark), lambda q: [1.0, 0.0]
    t.hierarchy = t.hierarchy.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    meta = ([("ACM", "Acme Inc")], [2019], ["Q1"], "10-Q", ["risk factors"])
    kind = "struct<companies:array<struct<ticker:string,name:string>>,years:array<int>,quarters:array<string>,filing_type_hint:string,section_hints:array<string>>"
    cited = "array<struct<child_chunk_id:string,score:double>>"
    t.turns = spark.createDataFrame([("x_0", "x", 0, "q", meta, [("acc1#001_0", 1.0)], [("c6", 1.0)], [1.0, 0.0])], f"id string, conversation_id string, turn_id int, modif_query string, parsed_metadata {kind}, sec_context {cited}, trans_context {cited}, embedding array<float>")
    a = pipeline.answer(t, "What were the risk factors?", conversation_id="x")
    assert a.asked == "What were the risk factors? for ACM in Q1_2019"
    assert (a.reuse_id, a.n_hits, a.n_calls) == ("x_0", 1, 1) and "Risk 1 1." in a.answer and "Concerns and risks 6." in a.answer
    b = pipeline.answer(t, "What were the risk factors?", conversation_id="y")
    assert b.route == "no_company" and b.reuse_id is None


def test_turns_as_a_stream(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    schema = "id string, conversation_id string, turn_id int, asked_at timestamp"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", "c", 0, t), ("b", "c", 1, t)], schema).coalesce(1).write.parquet(src)
    turns.upsert_stream(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    spark.createDataFrame([("b", "c", 7, t + dt.timedelta(1)), (None, "c", 2, t)], schema).coalesce(1).write.mode("append").parquet(src)
    turns.upsert_stream(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    assert {r.id: r.turn_id for r in spark.read.parquet(f"{out}/v=1").collect()} == {"a": 0, "b": 7}


def test_windowed_counts(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "x", 1.0), (t + dt.timedelta(minutes=30), "x", 2.0), (t + dt.timedelta(hours=1), "x", 4.0)], "ts timestamp, k string, v double")
    assert sorted((r.n, r.total) for r in turns.windowed_counts(df, "ts", "k", "v").collect()) == [(1, 4.0), (2, 3.0)]


def test_catalogue_over_small_tables(spark, data):
    for name, f in catalogue.QUERIES.items():
        df = f(spark, data)
        assert df.columns and df.limit(5).collect() is not None, name


def test_nothing_imports_the_training_subpackage():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarrylens.llm" not in p.read_text(), p


def test_columns_clash(spark):
    df = spark.createDataFrame([("a", "A", "10-K", "acc", dt.date(2024, 1, 1), "x", 1)], "rank string, company string, form string, accession string, date date, seq_ string, period_ int")
    assert graph.filing_chain(graph.filing_labels(df)).select(F.col("seq"), "period", "rank").first() == (1, "FY_2024", "a")


def test_service(spark):
    import time

    import pytest

    from quarrylens.plans.service import Service

    stocks = spark.createDataFrame([("quarterly", dt.date(2024, 1, 1), "A", "Close", 1.0)], "timeframe string, date date, company string, variable string, value double")
    ratios = spark.createDataFrame([("quarterly", "A", "Gross Margin", "2024Q1", 0.4), ("quarterly", "A", "Return on Equity", "2024Q1", 0.1), ("yearly", "A", "Gross Margin", "2024", 0.5)], "timeframe string, company string, metric string, period string, value double")
    s = Service(stocks, ratios, ratios)
    assert s.charts("A", ["Close", "x"]) == [{"date": "2024-01-01", "Close": 1.0}]
    assert s.ratios("A", variables=["Gross Margin"]) == [{"metric": "Gross Margin", "2024Q1": 0.4}]
    assert s.performance("A", "2024", "yearly") == [{"period": "2024", "Gross Margin": 0.5}] and s.performance("A", "Q3_1999") == []
    assert s.risk_matrix("A", "Q1_2024")["Profitability"] == 50.0
    with pytest.raises(ValueError):
        s.question("A", "2024", "x")
    few = Service(stocks, ratios, ratios, keep=2)
    for _ in range(4):
        few._tasks[few.submit("performance", "A", "2024", "yearly")].result()
    assert len(few._tasks) == 2
    good, bad = s.submit("charts", "A", ["Close"]), s.submit("ratios", "Nobody")
    for _ in range(300):
        if all(s.status(t)["status"] != "processing" for t in (good, bad)):
            break
        time.sleep(0.1)
    assert s.status(good)["data"] and s.status(bad)["status"] == "failed" and s.status("x") == {"status": "unknown"}


def test_index_and_zip(spark, tmp_path):
    import pytest

    from quarrylens.functions import dims
    from quarrylens.operators import search

    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0])], "id long, embedding array<float>")
    path = f"file://{tmp_path}/ix"
    assert search.build_index(v, path, 2) and not search.build_index(v, path, 2)
    assert [(r.id, [round(x, 6) for x in r.embedding]) for r in spark.read.parquet(path).collect()] == [(1, [0.6, 0.8])]
    assert dims.zipped(spark, [1, 2], ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        dims.zipped(spark, [1], [])


def test_completed_question(spark):
    from quarrylens.operators.queryplan import completed_question

    df = spark.createDataFrame([("and margins?", [], [], "HAL", "Q1_2008"), ("margins at FEN in 2009", ["FEN"], [2009], "HAL", "Q1_2008"), (None, [], [], "HAL", None), ("x", [], [], None, None)], "q string, t array<string>, y array<int>, bt string, bp string")
    got = [r[0] for r in df.select(completed_question(*[F.col(c) for c in ("q", "t", "y", "bt", "bp")])).collect()]
    assert got == ["and margins? for HAL in Q1_2008", "margins at FEN in 2009", None, "x"]


def test_hooks_and_memory(spark, tmp_path):
    from quarrylens.operators import queryplan

    t = _walk_tables(spark, 1, 2)
    asked = []
    t.parse = lambda rows, companies: asked.append(1) or queryplan.parsed(rows, companies)
    t.judge = lambda question, answer, evidence: (0.9, 0.2 if len(asked) == 1 else 0.8)
    t.memory_path = f"file://{tmp_path}/turns"
    q = "What were the risk factors of Acme in Q1 2019?"
    a = pipeline.answer(t, q, conversation_id="c")
    assert (a.route, a.analysis_retries, a.faithful, a.relevant) == ("exhausted", 3, 0.9, 0.2)
    a = pipeline.answer(t, q, conversation_id="c")
    assert (a.route, a.relevant, len(asked)) == ("accept", 0.8, 2)
    rows = spark.read.parquet(t.memory_path).collect()
    assert len(rows) == 2 and {(r.conversation_id, r.turn_id, r.modif_query, r.query_type) for r in rows} == {("c", 0, q, "SIMPLE")} and rows[0].parsed_metadata.quarters == ["Q1"]


def test_answers_begin_by_type(spark):
    a = pipeline.answer(_walk_tables(spark, 2, 1), "How did the risk factors of Acme change from Q1 2019 to Q2 2019?")
    assert a.query_type == "CHANGE_DETECTION" and "From the first period to the last, ACM:" in a.answer
