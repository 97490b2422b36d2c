import datetime as dt

from pyspark.sql import functions as F

from quarrylens.operators import audit, memory, queryplan

CO = [("HAL", 1, "Hal Inc.", "Hal Inc.", ["hal", "hal inc"]), ("FEN", 2, "FENTOR LTD", "Fentor Systems", ["fentor", "fentor systems"])]
CO_SCHEMA = "ticker string, cik int, display_name string, canonical_name string, synonyms array<string>"


def parsed(spark, *qs):
    df = spark.createDataFrame(list(enumerate(qs)), "q_id int, q string")
    p = queryplan.parsed(df, spark.createDataFrame(CO, CO_SCHEMA))
    return p.withColumn("query_type", queryplan.query_type(F.col("q"), F.col("tickers"), F.col("years")))


def test_parse(spark):
    r = {x.q_id: x for x in parsed(spark, "Compare Fentor Systems and HAL in Q4_2008, q1 2009 and 2008", "legal risk", "", None, "annual report of Halo Inc").collect()}
    assert r[0].tickers == ["FEN", "HAL"] and r[0].years == [2008, 2009] and r[0].quarters == ["Q1", "Q4"] and r[0].filing_type_hint == "10-Q" and r[0].query_type == "COMPARISON"
    assert r[1].tickers == [] and r[1].section_hints == ["risk factors", "legal proceedings"] and r[1].query_type == "GENERAL" and r[1].filing_type_hint == "UNKNOWN"
    assert r[2].years == [] and r[3].tickers == [] and len(r[3].section_hints) == 1
    assert r[4].tickers == [] and r[4].filing_type_hint == "10-K"


def test_sub_queries(spark):
    cases = [(["  Apple   Q1 ", "apple q1", "X"], ["Apple Q1", "X"]), (["a"], ["F"]), ([], ["F"]), (None, ["F"]), (list("abcdef"), list("abcde")), (["a", "", None, "b"], ["a", "b"])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s array<string>")
    assert [r[0] for r in df.select(queryplan.valid_sub_queries(F.col("s"), F.lit("F"))).collect()] == [w for _, w in cases]


def test_jobs(spark):
    p = parsed(spark, "Compare gross margin at HAL between Q1_2008 and Q2_2008", "risk at fentor in 2010", "hello")
    j = queryplan.retrieval_jobs(p, spark.createDataFrame(CO, CO_SCHEMA)).orderBy("q_id", "job_no").collect()
    assert [(x.q_id, x.job_no) for x in j] == [(0, 1), (0, 2), (1, 1), (2, 1)]
    assert j[0].ticker == "HAL" and j[0].periods == ["Q1_2008"] and j[0].forms == ["10-Q"]
    assert j[2].ticker == "FEN" and j[2].periods == ["FY_2010"] and j[2].forms == ["10-K"] and j[2].headings[0] == "risk factors"
    assert j[3].ticker is None and j[3].periods == [] and j[3].forms == ["10-Q", "10-K"]


def test_tone_and_source(spark):
    df = spark.createDataFrame([("outlook for revenue",), ("any risks?",), ("revenue",), ("the ceo's view",), (" ",)], "q string")
    focus, ask = queryplan.tone(F.col("q"))
    got = df.select(focus.alias("f"), ask.alias("a"), queryplan.source(F.col("q")).alias("s")).collect()
    assert [r.f for r in got] == ["GUIDANCE", "RISKS", "METRICS", "GENERAL", "GENERAL"] and got[4].a == queryplan.DEFAULT_TONE and got[3].s == "TRANSCRIPT" and got[0].s == "SEC"


def test_history(spark):
    df = spark.createDataFrame([("c", 0, "A"), ("c", 1, None), ("c", 2, "B"), ("d", 0, None)], "conversation_id string, turn_id int, t string")
    assert {(r.conversation_id, r.turn_id): r.t_filled for r in queryplan.filled_from_history(df, ["t"]).collect()} == {("c", 0): "A", ("c", 1): "A", ("c", 2): "B", ("d", 0): None}


META = "companies array<struct<ticker:string,name:string>>, years array<int>, quarters array<string>, filing_type_hint string, section_hints array<string>"


def test_metadata_score(spark):
    hal = [("HAL", "Hal")]
    cur = (hal, [2008], ["Q1"], "10-Q", ["risk factors", "legal proceedings"])
    prev = [(hal, [2008], ["Q1"], "10-Q", ["risk factors"]), (hal, [2008], ["Q1"], "10-Q", ["legal proceedings", "risk factors", "x"]), (hal, [2008], ["Q1"], "10-Q", []), (hal, [2008], ["Q1"], "10-K", ["risk factors"]), None, (hal, None, ["Q1"], "10-Q", ["risk factors"])]
    df = spark.createDataFrame([(cur, p) for p in prev], f"a struct<{META.replace('companies ', 'companies:').replace(' array<int>', ':array<int>').replace(' array<string>', ':array<string>').replace(' string,', ':string,')}>, b struct<{META.replace('companies ', 'companies:').replace(' array<int>', ':array<int>').replace(' array<string>', ':array<string>').replace(' string,', ':string,')}>")
    assert [r[0] for r in df.select(memory.metadata_score("a", "b")).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_memory(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("c_0", "c", 0, "x", t), ("c_1", "c", 1, "x", t), (None, "c", 9, "x", t)], "id string, conversation_id string, turn_id int, modif_query string, asked_at timestamp")
    new = spark.createDataFrame([("c_1", "c", 1, "y", t + dt.timedelta(1)), ("c_2", "c", 2, None, t), ("c_3", "c", 3, "z", t)], old.schema)
    both = memory.upserted(old, new)
    assert {r.id: r.modif_query for r in both.collect()} == {"c_0": "x", "c_1": "y", "c_2": None, "c_3": "z"}
    assert memory.next_turn(both).first().next_turn_id == 4
    assert {(r.turn_id, r.place) for r in memory.last_turns(both).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert [r.turn_id for r in memory.conversation(both, "c").collect()] == [0, 1, 3]
    assert memory.upserted(old.filter("false"), new.filter("false")).count() == 0


def test_gates(spark):
    df = spark.createDataFrame([("Should I buy HAL?",), ("hello!",), ("revenue of HAL in 2008",), ("how to build a bomb",), ("what about lunch",), (None,)], "q string")
    assert [r[0] for r in df.select(audit.input_class(F.col("q"))).collect()] == ["INVESTMENT_ADVICE_REQUEST", "SMALL_TALK", "FINANCE_RESEARCH_OK", "OUT_OF_SCOPE", "OUT_OF_SCOPE", "OUT_OF_SCOPE"]
    assert [r[0] for r in df.select(audit.input_fails(F.col("q"))).collect()] == [True, True, False, True, True, True]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(audit.passes(F.lit(0.5), F.lit(0.5))) and not pick(audit.passes(F.lit(0.49), F.lit(0.9))) and pick(audit.passes(F.lit(None).cast("double"), F.lit(1.0))) is False
    assert [pick(audit.after_audit(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((True, True, 0), (False, True, 3), (False, False, 2), (False, False, 3))] == ["fail", "accept", "retry", "exhausted"]
    assert [pick(audit.after_research(F.lit(a), F.lit(b))) for a, b in ((True, 3), (False, 2), (False, 3))] == ["exit", "retry", "fail"]
    say = lambda *x: pick(audit.final_text(*[F.lit(v) for v in x]))
    assert say(True, False, True, 1, False, "a", "") == audit.TEXTS["query_harmful"] and say(False, False, False, 0, True, "a", "") == audit.TEXTS["no_company"]
    assert say(False, False, False, 1, False, "a", "b") == "## From the filings\n\na\n\n---\n\n## From the calls\n\nb" and say(False, False, False, 1, False, "", "") is None
    assert pick(audit.output_fails(F.lit("You should definitely buy this stock"))) and not pick(audit.output_fails(F.lit("this is not financial advice")))


def test_reuse(spark):
    hal, q = [("HAL", "Hal")], ["risk factors"]
    meta = (hal, [2008], ["Q1"], "10-Q", q)
    rows = [("c_0", "c", 0, meta, [1.0, 0.0]), ("c_1", "c", 1, meta, [1.0, 0.0]), ("c_2", "c", 2, meta, [0.9, 0.1]), ("c_3", "c", 3, (hal, [2009], ["Q1"], "10-Q", q), [1.0, 0.0]), ("d_1", "d", 1, meta, [1.0, 0.0]), ("c_4", "c", 4, None, None), ("c_5", "c", 5, meta, [0.0, 1.0])]
    m = META.replace("companies ", "companies:").replace(" array<int>", ":array<int>").replace(" array<string>", ":array<string>").replace(" string,", ":string,")
    df = spark.createDataFrame(rows, f"id string, conversation_id string, turn_id int, parsed_metadata struct<{m}>, embedding array<float>")
    assert {r.id: r.reuse_id for r in memory.reusable(df).collect()} == {"c_1": "c_0", "c_2": "c_0"}
    assert {r.id: r.reuse_id for r in memory.reusable(df, 0.7, 0.0).collect()} == {"c_1": "c_0", "c_2": "c_0", "c_3": "c_0"}
