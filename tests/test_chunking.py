from pyspark.sql import functions as F

from quarrylens.operators import chunking
from quarrylens.sources import html, readers

T1, T2, T3, T4, TB = (" ".join([w] * n) for w, n in (("alpha", 25), ("beta", 10), ("gamma", 8), ("delta", 30), ("cell", 12)))
TRACE = [
    ("text", True, "Risk Overview"), ("text", False, T1), ("text", True, "Apple Inc. | 2024 Form 10-K | 7"), ("text", False, T2), ("text", True, "Competition"), ("text", False, T3), ("table", False, TB), ("text", True, "Partners"), ("text", False, T4),
]


def test_trace():
    a, b, c = chunking.run_machine(TRACE, "10-K", "Item 1A")
    assert (a["text"], a["is_table"], a["sub_headings"]) == (f"{T1} {T2}", False, {"level_1_heading": "Risk Overview"})
    assert (b["text"], b["is_table"]) == (T3 + TB, True)
    assert (c["text"], c["is_table"], c["sub_headings"]) == (T4, False, {"level_1_heading": "Competition"})


def test_trace_compat():
    _, b, c = chunking.run_machine(TRACE, "10-K", "Item 1A", compat=True)
    assert (b["text"], b["is_table"], b["sub_headings"]) == (T3 + TB, True, {})
    assert (c["text"], c["is_table"], c["sub_headings"]) == (f"{T3}\n{T4}", True, {})


def test_many_headings_and_item_switch():
    heads = [("text", True, f"H{i}") for i in range(4)]
    out = chunking.run_machine([*heads, ("text", False, T1)], "10-K", "Item 1")
    assert [o["text"] for o in out] == ["H0\nH1\nH2\nH3\n", T1]
    out = chunking.run_machine([("text", False, T1), ("text", True, "Legal Proceedings"), ("text", False, T4), ("table", False, "item " * 6)], "10-Q", "Item 1", {"Legal Proceedings": "Item 1: Legal"})
    assert [(o["item"], o["text"]) for o in out] == [("Item 1", T1), ("Item 1: Legal", T4)]


def test_chunks_of_filings(spark):
    rows = [("d", "10-K", "Item 1A", i, *e) for i, e in enumerate(TRACE)] + [("e", "10-K", "Item 1", 0, "text", False, None), (None, "10-K", "Item 1", 0, "text", False, T1)]
    df = spark.createDataFrame(rows, "doc_id string, form string, item string, seq int, kind string, is_header boolean, text string")
    assert [r.chunk_id for r in chunking.chunk_filings(df).orderBy("n").collect()] == ["d#1", "d#2", "d#3"]
    assert chunking.chunk_filings(df.filter("false")).count() == 0


def test_fold(spark):
    w = lambda n: " ".join(["w"] * n)
    cases = [(300, [300], False, []), (480, [400, 180], False, []), (900, [400, 350, 30, 220], False, [(0, 400), (1, 380), (3, 220)]), (900, [400, 350, 30, 20], False, [(0, 400), (1, 380), (3, 20)]), (900, [400, 350], True, []), (0, [], False, [])]
    df = spark.createDataFrame([(i, p, [w(n) for n in ps], t) for i, (p, ps, t, _) in enumerate(cases)], "i int, words int, pieces array<string>, is_table boolean")
    got = {r.i: [(c.key, len(c.text.replace(" ", ""))) for c in r.c] for r in df.select("i", chunking.fold_children(F.col("words"), F.col("pieces"), F.col("is_table")).alias("c")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_windows(spark):
    df = spark.createDataFrame([(1, " ".join(str(i) for i in range(25))), (2, "a"), (3, "  "), (4, None)], "doc_id int, text string")
    got = {}
    for r in chunking.windows(df, "doc_id", "text", 10, 3).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r.piece.split())
    assert list(got) == [1, 2] and got[2] == [["a"]]
    assert [p[0] for p in got[1]] == ["0", "7", "14", "21"] and got[1][-1][-1] == "24"


def test_furniture_and_tables(spark):
    df = spark.createDataFrame([("Apple Inc. | 2024 Form 10-K | 7",), ("12",), ("Department",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(chunking.is_footer(F.col("t"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in df.select(chunking.is_skipped_header(F.col("t"))).collect()][2] is True
    assert spark.range(1).select(chunking.accepted_table(F.lit("item " * 6)), chunking.accepted_table(F.lit("item " * 5))).first() == (False, True)


def test_contents(spark):
    items = spark.createDataFrame([("d", ["Item 1", "Item 1A", "Item 2", "Item 3"])], "doc_id string, items array<string>")
    tables = spark.createDataFrame([("d", 1, "item 1 only"), ("d", 2, "ITEM 1. x ITEM 1A. y"), ("d", 3, "item 1 item 1a")], "doc_id string, table_no int, text string")
    assert [r.table_no for r in chunking.contents_tables(tables, items).collect()] == [2]
    cells = spark.createDataFrame([("d", 0, 0, "x"), ("d", 0, 1, "Item 1"), ("d", 1, 1, "item 2"), ("d", 1, 2, "Item")], "doc_id string, row int, col int, text string")
    assert [r.col for r in chunking.index_column(cells).collect()] == [1]
    toc = spark.createDataFrame([("d", 2, "ITEM 1A.", "late"), ("d", 1, "Item 1A. ", "Risk Factors")], "doc_id string, row int, index_text string, heading string")
    its = spark.createDataFrame([("d", "Item 1A"), ("d", "Item 9"), ("e", "Item 1")], "doc_id string, item string")
    assert {tuple(r) for r in chunking.item_headings_10k(its, toc).collect()} == {("d", "Item 1A", "Item 1A: Risk Factors"), ("e", "Item 1", "Item 1")}
    q = spark.createDataFrame([("d", 0, "PART I.", ""), ("d", 1, "ITEM 1.", "Statements."), ("d", 2, "Other information", ""), ("d", 3, "Item 1a", ": Risk")], "doc_id string, row int, index_text string, heading string")
    assert {tuple(r) for r in chunking.item_headings_10q(q).collect()} == {("d", "Part I", "Item 1", "Item 1: Statements"), ("d", "Part II", "Item 1a", "Item 1a: Risk")}


def test_html(spark):
    page = "<html><head><title>no</title></head><h2>Item&nbsp;1</h2><p>Some <b>bold</b> text<p><b>All bold</b></p><table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table><script>x</script>tail"
    assert html.blocks(page) == [("text", True, "Item 1"), ("text", False, "Some bold text"), ("text", True, "All bold"), ("table", False, "a | b\n1"), ("text", False, "tail")]
    assert html.blocks(None) == [] and html.blocks("<p>open <table><tr><td>x")[0] == ("text", False, "open")
    assert html.blocks("<p><b><span>Heading</span></b></p><p><b>open</p><p>text</p>") == [("text", True, "Heading"), ("text", True, "open"), ("text", False, "text")]
    df = spark.createDataFrame([("d", page), ("e", None), (None, page)], "doc_id string, html string")
    assert html.html_elements(df).count() == 5


def test_readers(spark, tmp_path):
    (tmp_path / "HAL_10K.csv").write_text("filing_date,accession_number\n2024-02-01,x1\n2020-01-01,x2\nbad,\n")
    df = readers.read_filing_csvs(spark, f"file://{tmp_path}/*.csv", min_year=2023)
    assert [(r.ticker, r.accession_number) for r in df.collect()] == [("HAL", "x1")]
    (tmp_path / "c.json").write_text('[{"ID": "a#1", "Metadata": {"company": "A", "accession_no": "a", "filing_date": "2024-01-02"}, "Chunks": {"parent_chunk": "p", "child_chunks": {"a#1_0": "c"}}}]')
    r = readers.read_sec_json(spark, f"file://{tmp_path}/c.json").first()
    assert (r.chunk_id, r.item_heading, r.is_table, r.child_chunks) == ("a#1", "Not Found", False, {"a#1_0": "c"})
    (tmp_path / "t.json").write_text('[{"transcript": [{"Metadata": {"quarter": "Q1", "year": 2024, "company": "A"}, "ParentChunk": {"ID": "t1", "chunk": "x"}, "ChildChunks": {"t1_0": "y"}}]}]')
    assert readers.read_transcript_json(spark, f"file://{tmp_path}/t.json").first().fiscal_year == 2024
    readers.write_json(spark.range(2), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    readers.write_graph({"n": spark.range(1)}, f"file://{tmp_path}/g")
    assert spark.read.parquet(f"file://{tmp_path}/g/n").count() == 1


def test_parts_of_a_10q_switch_items(spark):
    toc = spark.createDataFrame([("q", "Part I", "Item 1", "Item 1: Financial Statements"), ("q", "Part I", "Item 2", "Item 2: Overview"), ("q", "Part II", "Item 1A", "Item 1A: Risk Factors")], "doc_id string, part string, item string, heading string")
    rows = [("q", "10-Q", "Part I", None, i, "text", *e) for i, e in enumerate([(True, "Financial Statements"), (False, T1), (True, "ITEM 2. Overview"), (False, T4)])]
    rows += [("q", "10-Q", "Part II", None, 10 + i, "text", *e) for i, e in enumerate([(False, T4), (True, "Risk Factors"), (False, T1)])]
    rows += [("k", "10-K", None, None, 0, "text", False, T1)]
    df = spark.createDataFrame(rows, "doc_id string, form string, part string, item string, seq int, kind string, is_header boolean, text string")
    got = [(r.doc_id, r.part, r.item, r.parent_chunk) for r in chunking.chunk_filings(df, item_headings=toc).orderBy("doc_id", "n").collect()]
    assert got == [("k", None, "Not Found", T1), ("q", "Part I", "Item 1: Financial Statements", T1), ("q", "Part I", "Item 2: Overview", T4), ("q", "Part II", None, T4), ("q", "Part II", "Item 1A: Risk Factors", T1)]


def test_sentence_windows(spark):
    text = "One two three. Four five six. Seven eight. Nine " + "ten " * 12
    df = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "a.")], "doc_id int, text string")
    got = {}
    for r in chunking.sentence_windows(df, "doc_id", "text", 8, 3).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r.piece)
        assert r.n_words == len(r.piece.split()) <= 8
    assert got[4] == ["a."] and set(got) == {1, 4}
    assert got[1][0] == "One two three. Four five six. Seven eight." and got[1][1].startswith("Nine ten")
    assert chunking.packed_sentences(["a b c.", "d e.", "f g h."], 6, 2) == ["a b c. d e.", "d e. f g h."]
    assert chunking.sentence_windows(df, "doc_id", "text", 8, 3, split=lambda t: [t]).count() >= 2
