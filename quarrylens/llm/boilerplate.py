"""Lines that one source repeats across its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import staged

HOT_SHARE = 5000  # a line that makes up a 5,000th of all places is hot: by counting, at most 5,000 lines are
LETTERS = "regexp_replace(lower({}), '[^a-z]+', '')"


def line_key(text: str) -> str:
    """SQL: a hash of a line's letters a to z in order, ignoring case and all else; null for a line without one."""
    letters = LETTERS.format(text)
    return f"nullif(xxhash64({letters}), xxhash64(''))"


def source_lines(df: DataFrame, id_col: str = "chunk_id", source_col: str = "company", text_col: str = "parent_chunk", date_col: str = "filing_date", version_col: str = "ingested_at") -> DataFrame:
    """One row per document: id, src (hash of the source's name without blanks around it, ignoring case), day, keys (one per
    line, null for a line without letters). Of several rows with one id the latest version counts; at equal versions the one
    with the greater lines. Rows with a null id, source or text are left out. Only hashes are shuffled, never texts.
    """
    src = F.expr(r"xxhash64(lower(regexp_replace(s, '^\\s+|\\s+$', '')))")
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("s"), F.col(text_col).alias("t"), F.col(date_col).cast("date").alias("day"), F.col(version_col).alias("v")
    ).filter("id IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")
    rows = rows.select("id", "v", src.alias("src"), "day", F.expr(f"transform(split(t, '\\n'), x -> {line_key('x')})").alias("keys"))
    latest = rows.groupBy("id").agg(F.max(F.struct("v", "keys", "src", "day")).alias("r"))
    return latest.select("id", "r.src", "r.day", "r.keys")


def line_counts(docs: DataFrame) -> DataFrame:
    """src, key, n_clusters, n_dates, n_docs of each line of source_lines().

    Duplicates are collapsed first: documents of one source whose lines all agree are one cluster, dated by its earliest day.
    A line counts once for each cluster and once for each of their dates; n_docs is the number of documents in its clusters,
    so republished copies can be told from true repetition. Copies are counted by partial aggregation, so a group that holds
    a third of all rows costs no task more than its share.
    """
    lines = F.array_distinct(F.expr("filter(keys, k -> k IS NOT NULL)"))
    clusters = docs.select("src", "day", lines.alias("lines"), F.xxhash64("src", "keys").alias("c")).groupBy("src", "c").agg(F.count("*").alias("n"), F.min("day").alias("day"), F.first("lines").alias("lines"))
    each = clusters.select("src", "n", "day", F.explode("lines").alias("key"))
    by_day = each.groupBy("src", "key", "day").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_docs"))
    return by_day.groupBy("src", "key").agg(F.sum("n_clusters").alias("n_clusters"), F.count("day").alias("n_dates"), F.sum("n_docs").alias("n_docs"))


def repeated_lines(docs: DataFrame, min_docs: int = 1, min_clusters: int = 1, min_dates: int = 0) -> DataFrame:
    """The lines of line_counts() that reach all three limits."""
    return line_counts(docs).filter((F.col("n_docs") >= min_docs) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))


def repeated_places(docs: DataFrame, **limits: int) -> DataFrame:
    """id, line_no (from 1) of every place where a repeated line stands. docs: a staged source_lines() table, read twice.

    Hot lines are matched by a broadcast of at most HOT_SHARE rows, all others by a shuffle in which no key has more than a
    HOT_SHARE-th of the rows.
    """
    found = staged(repeated_lines(docs, **limits).select("src", "key", "n_docs"), "lines")
    total = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hot = F.col("n_docs") * HOT_SHARE >= F.lit(total)
    places = docs.select("id", "src", F.posexplode("keys").alias("line_no", "key")).filter("key IS NOT NULL").withColumn("line_no", F.col("line_no") + 1)
    marked = places.join(F.broadcast(found.filter(hot).select("src", "key", F.lit(True).alias("is_hot"))), ["src", "key"], "left")
    cold = marked.filter("is_hot IS NULL").join(found.filter(~hot).select("src", "key").hint("shuffle_hash"), ["src", "key"], "left_semi")
    return marked.filter("is_hot").select("id", "line_no").unionByName(cold.select("id", "line_no"))


def line_texts(df: DataFrame, found: DataFrame, source_col: str = "company", text_col: str = "parent_chunk") -> DataFrame:
    """found (src, key and others) with company, the source without blanks around it in lower case, and line, the letters that its
    lines agree in. found is small against the lines of df; these are matched by a semi-join before they are grouped."""
    rows = df.select(F.expr(rf"lower(regexp_replace({source_col}, '^\\s+|\\s+$', ''))").alias("c"), F.col(text_col).alias("t")).filter("c IS NOT NULL AND t IS NOT NULL")
    lines = rows.select("c", F.xxhash64("c").alias("src"), F.explode(F.split("t", "\n")).alias("l"))
    lines = lines.select("c", "src", F.expr(LETTERS.format("l")).alias("line"), F.expr(line_key("l")).alias("key"))
    named = lines.join(found.select("src", "key"), ["src", "key"], "left_semi").groupBy("src", "key").agg(F.min("c").alias("company"), F.min("line").alias("line"))
    return found.join(named, ["src", "key"])


def remove_repeated(df: DataFrame, places: DataFrame, id_col: str = "chunk_id", text_col: str = "parent_chunk") -> DataFrame:
    """id, text without the lines at places, n_removed; one row for each row of df with a non-null id.

    Null text stays null. A text of which every line goes comes out empty. The other lines keep their order and content.
    """
    gone = places.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("id IS NOT NULL")
    kept = "array_join(filter(split(t, '\\n'), (x, i) -> NOT array_contains(gone, i + 1)), '\\n')"
    return rows.join(gone, "id", "left").select("id", F.expr(f"CASE WHEN gone IS NULL THEN t ELSE {kept} END").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
