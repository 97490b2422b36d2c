"""Queries pN_... of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.llm import boilerplate, knn, near_dup, packing, pairs, reading, splitting, tokens
from quarrylens.llm.versions import latest_texts
from quarrylens.session import staged

Query = Callable[[SparkSession, str], DataFrame]
P5_RULE = near_dup.JoinRule(n_words=3, threshold=0.6)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    chunks = _table(spark, d, "sec_chunks").filter("NOT is_table")
    return staged(boilerplate.source_lines(chunks), "lines-of")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_places(_lines(spark, d), min_docs=5).select(F.col("id").alias("chunk_id"), F.col("line_no").cast("int").alias("line_no"))


def p1_line_report(spark: SparkSession, d: str) -> DataFrame:
    """The method's own reading of excess: five clusters of copies on two dates."""
    r = staged(boilerplate.repeated_lines(_lines(spark, d), min_docs=5), "report")
    r = boilerplate.line_texts(_table(spark, d, "sec_chunks").filter("NOT is_table"), r)
    return r.select("company", "line", "n_docs", "n_clusters", "n_dates", ((F.col("n_clusters") >= 5) & (F.col("n_dates") >= 2)).alias("is_boilerplate"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the lines that stand in five distinct texts of their company, on two dates: what only a republished text
    repeats stays."""
    chunks = _table(spark, d, "sec_chunks").filter("NOT is_table")
    places = boilerplate.repeated_places(_lines(spark, d), min_clusters=5, min_dates=2)
    latest = latest_texts(chunks.select(F.col("chunk_id").alias("id"), F.col("ingested_at").alias("v"), F.col("parent_chunk").alias("t")))
    return boilerplate.remove_repeated(latest, places, "id", "t").withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, d, "conversation_turns"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.most_similar(_table(spark, d, "chunk_embeddings"), min_cosine=0.8)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest, however far, for the queries whose hashed id is divisible by 20, against all rows."""
    return knn.most_similar(_table(spark, d, "chunk_embeddings"), query_filter=F.expr("pmod(crc32(id), 20) = 0"), recall=0.94)


def p3_all(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest, however far, of every usable vector."""
    return knn.most_similar(_table(spark, d, "chunk_embeddings"), recall=0.94)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.check_splits(_table(spark, d, "sec_chunks")).filter("NOT is_valid").select("chunk_id")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, d, "sec_chunks"))


def p4_split_valid(spark: SparkSession, d: str) -> DataFrame:
    """The ids of which the new pieces pass the check of stored ones."""
    c = _table(spark, d, "sec_chunks").filter("NOT is_table AND length(parent_chunk) > 2000")
    last = latest_texts(c.select(F.col("chunk_id").alias("id"), F.col("ingested_at").alias("v"), F.col("parent_chunk").alias("t")))
    pieces = splitting.split_oversized(c).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "chunk_id", "piece_no"), "piece"))).alias("child_chunks"))
    made = pieces.join(last.withColumnRenamed("id", "chunk_id"), "chunk_id").select("chunk_id", F.col("t").alias("parent_chunk"), "child_chunks", F.lit(False).alias("is_table"), F.lit(0).alias("ingested_at"))
    return splitting.check_splits(made).filter("is_valid").select("chunk_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "sec_chunks").filter("NOT is_table").select("chunk_id", "parent_chunk")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = near_dup.similar_pairs(_texts(spark, d), "chunk_id", "parent_chunk", P5_RULE)
    return p.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.similar_groups(_texts(spark, d), "chunk_id", "parent_chunk", P5_RULE).withColumnRenamed("id", "chunk_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(_table(spark, d, "documents")), (2048,))


def p7_packing_lengths(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(_table(spark, d, "documents")), (512, 1024, 2048))


def _packed_well(packed: DataFrame) -> DataFrame:
    """One row: documents and tokens that were packed, and containers that are too full, badly numbered or larger than needed."""
    w = Window.partitionBy("container_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    p = packed.withColumn("before", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    c = p.groupBy("container_id").agg(F.count("*").alias("n"), F.countDistinct("place").alias("n_places"), F.max("place").alias("last"), F.sum("n_tokens").alias("used"), F.max("capacity").alias("cap"), F.min("capacity").alias("cap_"), F.sum((F.col("start") != F.col("before")).cast("int")).alias("off"))
    bad = (F.col("used") > F.col("cap")) | (F.col("cap") != F.col("cap_")) | (F.col("n") != F.col("n_places")) | (F.col("last") != F.col("n") - 1) | (F.col("off") > 0)
    n_bad = c.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"))
    # whole ones: a document of several parts fills all but the last
    docs = packed.groupBy("doc_id").agg(F.max("part").alias("parts"), F.sum("n_tokens").alias("n"))
    d = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(((F.col("n") <= 2048) & (F.col("parts") > 0)).cast("long")), F.lit(0)).alias("n_divided"))
    return d.join(F.broadcast(n_bad))  # one row each


def p7_packing_check(spark: SparkSession, d: str) -> DataFrame:
    return _packed_well(staged(p7_packing(spark, d), "packed"))


def p7_packing_lengths_check(spark: SparkSession, d: str) -> DataFrame:
    return _packed_well(staged(p7_packing_lengths(spark, d), "packed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents, and with what scores, stand at each level."""
    r = reading.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels"))
    return r.groupBy("reading_level").agg(F.count("*").alias("n_docs"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("most"))


def queries() -> dict[str, Query]:
    own = globals()
    names = ["p1_found", "p1_line_report", "p1_clean", "p2_found", "p3_found", "p3_neighbours", "p3_all", "p4_found", "p4_split", "p4_split_valid", "p5_found", "p5_groups", "p6_ids", "p7_packing", "p7_packing_lengths", "p7_packing_check", "p7_packing_lengths_check", "p8_found", "p8_profile"]
    return {n: own[n] for n in names}


_LATEST = "SELECT * FROM sec_chunks WHERE {} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1"
_LINES = """r AS (SELECT chunk_id, lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) AS c, parent_chunk AS t FROM (%s)),
l AS (SELECT chunk_id, c, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM r),
k AS (SELECT chunk_id, c, n, regexp_replace(lower(s), '[^a-z]+', '', 'g') AS k FROM l),
g AS (SELECT c, k FROM k WHERE k <> '' GROUP BY c, k HAVING count(DISTINCT chunk_id) >= 5)""" % _LATEST.format("NOT is_table AND company IS NOT NULL AND parent_chunk IS NOT NULL")

# documents whose lines agree are one cluster, dated by its first day
_CLUSTERS = _LINES + """, days AS (SELECT chunk_id, c, filing_date AS day, list(k ORDER BY n) FILTER (k <> '') AS ks FROM k JOIN (SELECT chunk_id, filing_date FROM (%s)) USING (chunk_id) GROUP BY ALL),
cl AS (SELECT c, ks, count(*) AS n, min(day) AS day FROM days WHERE ks IS NOT NULL GROUP BY ALL), el AS (SELECT c, n, day, unnest(list_distinct(ks)) AS k FROM cl),
lc AS (SELECT c, k, sum(n) AS n_docs, count(*) AS n_clusters, count(DISTINCT day) AS n_dates FROM el GROUP BY ALL)""" % _LATEST.format("NOT is_table AND company IS NOT NULL AND parent_chunk IS NOT NULL")
_SETS = """b AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(parent_chunk), '[a-z0-9]+') AS w FROM sec_chunks WHERE NOT is_table AND chunk_id IS NOT NULL AND parent_chunk IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM b WHERE len(w) >= 3),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT p.chunk_id AS a, q.chunk_id AS b, count(*) AS m FROM s p JOIN s q ON p.x = q.x AND p.chunk_id < q.chunk_id GROUP BY ALL),
pair AS (SELECT a, b, m = x.n AND m = y.n AS same FROM m JOIN n x ON a = x.chunk_id JOIN n y ON b = y.chunk_id WHERE m / (x.n + y.n - m) >= 0.6)"""

ORACLE = {
    "p1_line_report": f"WITH {_CLUSTERS} SELECT c AS company, k AS line, CAST(n_docs AS BIGINT) AS n_docs, CAST(n_clusters AS BIGINT) AS n_clusters, n_dates, n_clusters >= 5 AND n_dates >= 2 AS is_boilerplate FROM lc WHERE n_docs >= 5",
    "p4_split_valid": "SELECT DISTINCT chunk_id FROM sec_chunks WHERE NOT is_table AND length(parent_chunk) > 2000 AND chunk_id IS NOT NULL",
    "p7_packing_check": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_bad FROM documents WHERE text IS NOT NULL",
    "p7_packing_lengths_check": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_bad FROM documents WHERE text IS NOT NULL",
    # copies are a class named by its least id; components by steps from class to class
    "p5_groups": f"""WITH RECURSIVE {_SETS}, rep AS (SELECT chunk_id, least(chunk_id, coalesce(min(a), chunk_id)) AS rep FROM n LEFT JOIN (SELECT a, b FROM pair WHERE same) ON b = chunk_id GROUP BY chunk_id),
size AS (SELECT rep, count(*) AS n_copies FROM rep GROUP BY 1), link AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair) p JOIN rep x ON p.a = x.chunk_id JOIN rep y ON p.b = y.chunk_id WHERE x.rep <> y.rep),
reach AS (SELECT rep AS a, rep AS b FROM size UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, min(b) AS "group" FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT chunk_id, rep.rep, "group", coalesce(n_links, 0) AS n_links, n_copies FROM rep JOIN size USING (rep) JOIN root ON root.a = rep.rep LEFT JOIN deg ON deg.a = rep.rep""",
    "p1_found": f"WITH {_LINES} SELECT chunk_id, CAST(n AS INT) AS line_no FROM k JOIN g USING (c, k)",
    "p1_clean": f"""WITH {_CLUSTERS}, found AS (SELECT chunk_id, list(n) AS gone FROM k JOIN lc USING (c, k) WHERE n_clusters >= 5 AND n_dates >= 2 GROUP BY chunk_id), base AS (SELECT chunk_id, parent_chunk AS t FROM ({_LATEST.format("NOT is_table AND chunk_id IS NOT NULL")}))
SELECT chunk_id, CASE WHEN gone IS NULL THEN t ELSE coalesce(array_to_string(list_filter(string_split(t, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END AS text, CAST(coalesce(len(gone), 0) AS INT) AS n_removed FROM base LEFT JOIN found USING (chunk_id)""",
    # the split is checked piece by piece, each from where the piece before was found
    "p4_found": f"""WITH RECURSIVE c AS (SELECT chunk_id, parent_chunk AS t, list_transform(list_sort(list_transform(map_entries(child_chunks), lambda e: {{'n': CAST(regexp_extract(e.key, '_([0-9]+)$', 1) AS INT), 'p': e.value}})), lambda e: e.p) AS ps FROM ({_LATEST.format("NOT is_table AND length(parent_chunk) > 2000")})),
step AS (SELECT chunk_id, 0 AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, coalesce(len(ps), 0) > 0 AS ok FROM c
UNION ALL
SELECT chunk_id, i + 1, place, place + length(p), coalesce(length(p) BETWEEN 1 AND 2000 AND found > 0 AND CASE WHEN i = 0 THEN place = 0 ELSE e - place BETWEEN 100 AND 400 END
  AND NOT (i + 1 < n AND regexp_matches(substr(t, place + length(p), 2), '^[a-zA-Z0-9][a-zA-Z0-9]$') AND regexp_matches(right(p, 400), '[ ' || chr(10) || ']')) AND (i + 1 < n OR place + length(p) = length(t)), false)
FROM (SELECT chunk_id, i, e, t, p, n, instr(substr(t, off + 1), p) AS found, off + instr(substr(t, off + 1), p) - 1 AS place FROM (SELECT step.*, t, ps[i + 1] AS p, len(ps) AS n, CASE WHEN i = 0 THEN 0 ELSE s + 1 END AS off FROM step JOIN c USING (chunk_id) WHERE ok AND i < len(ps))))
SELECT chunk_id FROM step WHERE NOT ok""",
    "p5_found": f"WITH {_SETS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM pair",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
