import math
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.functions.scalars import cosine
from quarrylens.operators import search

V = "id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(60)]
    return rows, spark.createDataFrame([*rows, (60, None, 0), (61, [0.0] * 8, 0), (62, [1.0], 0), (63, rows[5][1], 2)], V)


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * len(a)) / math.dist(b, [0] * len(b))


def test_top_k_is_exact_with_ties_by_id(vectors):
    rows, df = vectors
    got = [r.id for r in search.top_k(df, rows[5][1], 10).collect()]
    want = sorted([*rows, (63, rows[5][1], 2)], key=lambda r: (-round(cos(r[1], rows[5][1]), 6), r[0]))[:10]
    assert got == [r[0] for r in want] and got[:2] == [5, 63]
    assert "TakeOrderedAndProject" in search.top_k(df, rows[5][1], 10)._jdf.queryExecution().executedPlan().toString()


def test_post_filter_is_among_the_candidates(vectors):
    rows, df = vectors
    post = search.filtered_top_k(df, rows[0][1], 3, F.col("label") == 1, "post", 9).collect()
    pre = search.filtered_top_k(df, rows[0][1], 3, F.col("label") == 1, "pre").collect()
    near = {r.id for r in search.top_k(df, rows[0][1], 9).collect()}
    assert {r.id for r in post} <= near and len(pre) == 3 and len(post) <= 3
    with pytest.raises(ValueError):
        search.filtered_top_k(df, rows[0][1], 3, F.lit(True), "both")


def test_jobs(spark, vectors):
    rows, df = vectors
    jobs = spark.createDataFrame([(i, rows[i][1]) for i in range(3)], "job_id int, q_vec array<float>")
    got = search.jobs_top_k(df, jobs, F.col("label") == F.col("job_id"), 2).collect()
    for j in range(3):
        mine = [r.id for r in sorted((r for r in got if r.job_id == j), key=lambda r: r.rank)]
        assert mine == [r[0] for r in sorted((r for r in [*rows, (63, rows[5][1], 2)] if r[2] == j), key=lambda r: (-round(cos(r[1], rows[j][1]), 9), r[0]))[:2]]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("", 5), (None, 6), ("b", 2)], "id string, pos int")
    once = search.keep_first(df, "id", ["pos"])
    assert {tuple(r) for r in once.collect()} == {("a", 0), ("b", 2)}
    assert search.keep_first(once, "id", ["pos"]).count() == 2


def test_rerank(spark):
    df = spark.createDataFrame([(1, "x", "revenue growth", "the revenue", 0.1), (1, "y", "revenue growth", "revenue and growth", 0.0), (1, "z", "revenue growth", None, 0.9), (2, "w", "", "t", 0.5)], "job int, id string, q string, parent_text string, score double")
    r = {(x.job, x.rerank): (x.id, x.rerank_score) for x in search.rerank(df, 2, by=["job"]).collect()}
    assert r == {(1, 1): ("y", 1.0), (1, 2): ("x", 0.5), (2, 1): ("w", 0.0)}
    assert search.rerank(df.filter("false"), 2).count() == 0


def test_cosine_nulls_and_hashed_embedding(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]
    e = spark.createDataFrame([("a word and a word",), ("",), (None,)], "t string").select(search.hashed_embedding(F.col("t"), 16).alias("e")).collect()
    assert abs(sum(x * x for x in e[0].e) - 1) < 1e-9 and e[1].e is None and e[2].e is None


def test_rerank_without_groups_and_without_a_scorer(spark):
    rows = [(i, "alpha beta", "alpha beta" if i == 3 else "alpha", 1.0 - i / 10) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, q string, parent_text string, score double")
    assert [(r.id, r.rerank) for r in search.rerank(df, 2).orderBy("rerank").collect()] == [(3, 1), (0, 2)]

    def broken(q, t):
        raise RuntimeError("no model")

    assert [(r.id, r.rerank_score) for r in search.rerank(df, 2, scorer=broken).orderBy("rerank").collect()] == [(0, None), (1, None)]


def test_written_index_is_searched(spark, tmp_path):
    v = spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(8)] + [(9, [0.0, 0.0]), (10, [1.0])], "id int, embedding array<double>")
    path = f"file://{tmp_path}/index"
    assert search.build_index(v, path, 2) and not search.build_index(v, path, 2)
    assert [r.id for r in search.index_top_k(spark, path, [1.0, 0.0], 3).collect()] == [0, 1, 2]


def test_hashed_embedding_has_norm_one(spark):
    df = spark.createDataFrame([("a b a",), ("a b a",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(search.hashed_embedding(F.col("t"), 16).alias("v")).collect()]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-12 and got[2] is None and got[3] is None


def test_grouped_search_in_blocks_is_that_of_the_jobs(spark, monkeypatch):
    r = random.Random(4)
    vs = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(12)]  # few, so that many are equal or parallel
    rows = [(i, "ab"[i % 2], r.choice(vs)) for i in range(300)] + [(300, "a", None), (301, "a", [1.0, None, 1.0, 1.0]), (302, "a", [1.0]), (303, None, vs[0]), (304, "c", vs[0])]
    v = spark.createDataFrame(rows, "id int, g string, embedding array<float>")
    asks = [(i, "abd"[i % 3], [float(r.randrange(-2, 3)) for _ in range(4)]) for i in range(90)] + [(90, "a", None), (91, None, vs[0]), (92, "a", [2.0])]
    jobs = spark.createDataFrame(asks, "job_id int, who string, q_vec array<float>")
    want = {(x.job_id, x.id, x.score, x.rank) for x in search.jobs_top_k(v, jobs, F.col("g") == F.col("who"), 7).collect()}
    assert {(x.job_id, x.id, x.score, x.rank) for x in search.grouped_top_k(v, jobs, "g", "who", 7).collect()} == want
    for name, n in (("VECTOR_BLOCK", 40), ("JOB_BLOCK", 10), ("TILE", 3)):
        monkeypatch.setattr(search, name, n)
    assert {(x.job_id, x.id, x.score, x.rank) for x in search.grouped_top_k(v, jobs, "g", "who", 7).collect()} == want


def test_budgets_of_more_than_10_000_turns(spark, data, tmp_path):
    import os

    from quarrylens.plans import catalogue

    for f in os.listdir(data):
        if f != "conversation_turns.parquet":
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    t = spark.read.parquet(f"{data}/conversation_turns.parquet")
    copies = t.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2000)))).withColumn("id", F.concat_ws("~", "id", "n")).filter("id NOT LIKE '~%'").drop("n")
    copies.write.parquet(f"{tmp_path}/conversation_turns.parquet")
    want = {tuple(r) for r in catalogue.multi_query_budgets(spark, data).collect()}
    got = catalogue.multi_query_budgets(spark, str(tmp_path)).withColumn("job_id", F.substring_index("job_id", "~", 1))
    assert got.select("job_id").count() > 2001 * 5 and want
    assert {(tuple(r)[:-1], r[-1]) for r in got.groupBy("job_id", "source", "child_id", "place").count().collect()} == {(x, 2001) for x in want}


def test_budgets_are_those_of_sql_where_vectors_are_not_finite(spark, data, tmp_path):
    import os

    duckdb = pytest.importorskip("duckdb")
    from quarrylens.plans import catalogue, oracle

    for f in os.listdir(data):
        if f != "chunk_embeddings.parquet":
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    e = spark.read.parquet(f"{data}/chunk_embeddings.parquet")
    odd = F.when(F.crc32("id") % 7 == 0, float("inf")).when(F.crc32("id") % 7 == 1, float("nan")).cast("float")
    e.withColumn("openai_embedding", F.when(odd.isNotNull() & (F.size("openai_embedding") == 128), F.concat(F.array(odd), F.slice("openai_embedding", 2, 127))).otherwise(F.col("openai_embedding"))).coalesce(1).write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    c = duckdb.connect()
    for f in os.listdir(tmp_path):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tmp_path}/{f}{'/*.parquet' if f.startswith('chunk_e') else ''}'")
    got = {tuple(r) for r in catalogue.multi_query_budgets(spark, str(tmp_path)).collect()}
    assert got == set(c.sql(oracle.ORACLE["multi_query_budgets"]).fetchall()) and got
