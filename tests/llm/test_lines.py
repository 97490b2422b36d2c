import datetime as dt

import pytest

from quarrylens.llm import boilerplate as b

SCHEMA = "chunk_id string, company string, parent_chunk string, filing_date date, ingested_at timestamp, id string, keys int, src string"
T, D = dt.datetime(2024, 1, 1), dt.date(2024, 1, 1)


def table(spark, rows):
    full = [(i, c, t, d, v, "clash", 7, "clash") for i, c, t, d, v in rows]
    return spark.createDataFrame(full, SCHEMA)


def places(spark, rows, **limits):
    docs = b.source_lines(table(spark, rows))
    return sorted((r.id, r.line_no) for r in b.repeated_places(docs.cache(), **limits).collect())


def test_counts_ids_not_rows(spark):
    rows = [(f"c{i}", " Hal Inc " if i % 2 else "HAL INC", f"own text {'abcdef'[i]}\nShare this PAGE!\n\n123", D, T) for i in range(5)]
    assert places(spark, rows, min_docs=5) == [(f"c{i}", 2) for i in range(5)]
    assert places(spark, [*rows[:4], rows[0]], min_docs=5) == []  # a repeated row is no further chunk
    assert places(spark, [*rows[:4], ("c9", "other", rows[0][2], D, T)], min_docs=5) == []


def test_lines_are_letters_only_and_within_a_text_count_once(spark):
    rows = [(f"c{i}", "x", t, D, T) for i, t in enumerate(["Read more", "READ-MORE 7", "  read\tmore\r", "read more\nread more", "Réad more"])]
    assert places(spark, rows, min_docs=4) == [("c0", 1), ("c1", 1), ("c2", 1), ("c3", 1), ("c3", 2)]
    assert places(spark, rows, min_docs=5) == []


def test_nulls_and_empty(spark):
    rows = [(None, "x", "a", D, T), ("c1", None, "a", D, T), ("c2", "x", None, None, None), ("c3", "x", "", None, None), ("c4", "", "1\n2", D, T)]
    assert places(spark, rows, min_docs=1) == []
    assert places(spark, [], min_docs=1) == []


def test_copies_are_collapsed(spark):
    copies = [(f"c{i}", "x", "same body\nfoot line", D, T) for i in range(6)]
    others = [(f"d{i}", "x", f"other {w}\nfoot line", dt.date(2024, 1, 1 + i), T) for i, w in enumerate(("one", "two"))]
    got = {(r.n_docs, r.n_clusters, r.n_dates) for r in b.line_counts(b.source_lines(table(spark, copies + others))).collect()}
    assert got == {(6, 1, 1), (8, 3, 2), (1, 1, 1)}
    assert places(spark, copies + others, min_docs=5, min_clusters=3) == sorted([(f"c{i}", 2) for i in range(6)] + [("d0", 2), ("d1", 2)])
    assert places(spark, copies + others, min_docs=1, min_clusters=3, min_dates=3) == []


def test_latest_version_counts(spark):
    rows = [(f"c{i}", "x", "foot", D, T) for i in range(5)] + [("c0", "x", "new text", D, T + dt.timedelta(1))]
    assert places(spark, rows, min_docs=5) == [] and len(places(spark, rows, min_docs=4)) == 4


def test_removal(spark):
    rows = [(f"c{i}", "x", f"{w}\nfoot\r\nend {w}", D, T) for i, w in enumerate(("aa", "bb"))] + [("c2", "x", "foot", D, T), ("c3", "x", None, D, T)]
    docs = b.source_lines(table(spark, rows))
    got = {r.id: (r.text, r.n_removed) for r in b.remove_repeated(table(spark, rows), b.repeated_places(docs.cache(), min_docs=3)).collect()}
    assert got == {"c0": ("aa\nend aa", 1), "c1": ("bb\nend bb", 1), "c2": ("", 1), "c3": (None, 0)}


def test_one_source_with_most_rows_and_a_long_text(spark):
    rows = [(f"c{i}", "hot" if i % 3 else f"s{i}", f"unique {i} {chr(97 + i % 26) * (i % 50 + 1)}\nhot line", D, T) for i in range(300)]
    rows.append(("long", "hot", "\n".join(["hot line"] * 5000), D, T))
    got = places(spark, rows, min_docs=5)
    lines = {i: n for i, n in got if n == 2}
    assert len([1 for i, _ in got if i == "long"]) == 5000 and len(lines) >= 200


@pytest.mark.parametrize("share", [1, 10**9])
def test_hot_and_cold_paths_agree(spark, monkeypatch, share):
    monkeypatch.setattr(b, "HOT_SHARE", share)  # 1: hardly any line is hot; 10^9: all are
    rows = [(f"c{i}", "x", f"l{'abcdefghij'[i]} own\nfoot\nhead", D, T) for i in range(6)]
    assert places(spark, rows, min_docs=5) == sorted((f"c{i}", n) for i in range(6) for n in (2, 3))


def test_report_names_sources_and_lines(spark):
    rows = [(f"c{i}", " Hal Inc ", f"own {'abcdef'[i]}\nShare this PAGE!", D, T) for i in range(3)]
    df = table(spark, rows)
    got = b.line_texts(df, b.repeated_lines(b.source_lines(df), min_docs=3)).collect()
    assert [(r.company, r.line, r.n_docs) for r in got] == [("hal inc", "sharethispage", 3)]


def test_latest_texts(spark, monkeypatch):
    from quarrylens.llm import versions

    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, None), ("c", 3, "x"), ("c", 3, "y"), (None, 9, "z"), ("d", None, "p"), ("d", 0, "q")]
    df = spark.createDataFrame(rows, "id string, v int, t string")
    for most in (10, 0):
        monkeypatch.setattr(versions, "MOST_IDS", most)
        assert sorted((r.id, r.t) for r in versions.latest_texts(df).collect()) == [("a", "new"), ("b", None), ("c", "y"), ("d", "q")]
    assert versions.latest_texts(df.filter("false")).count() == 0
