"""Conversation turns: upsert, history, and reuse of an earlier turn's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import cosine, latest

SIM_THRESHOLD, META_THRESHOLD = 0.70, 0.95


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "asked_at") -> DataFrame:
    """Both tables with one row for each key, the latest; rows with a null key are dropped."""
    both = old.unionByName(new, allowMissingColumns=True)
    return latest(both.filter(F.col(key).isNotNull()), [key], [order])


def conversation(turns: DataFrame, conversation_id: str) -> DataFrame:
    """A conversation's turns with a question, in order, arrays never null."""
    rows = turns.filter((F.col("conversation_id") == conversation_id) & F.col("modif_query").isNotNull())
    none = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("sec_context", "trans_context", "embedding", "embedding_trans") if c in rows.columns}
    return rows.withColumns(none).orderBy("turn_id")


def next_turn(turns: DataFrame) -> DataFrame:
    """conversation_id, next_turn_id."""
    return turns.groupBy("conversation_id").agg((F.coalesce(F.max("turn_id"), F.lit(-1)) + 1).alias("next_turn_id"))


def last_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last n turns of each conversation with their place, oldest first. row_number() <= n is pushed below the shuffle."""
    w = Window.partitionBy("conversation_id")
    kept = turns.withColumn("_r", F.row_number().over(w.orderBy(F.desc("turn_id"), "id"))).filter(F.col("_r") <= n)
    return kept.withColumn("place", F.row_number().over(w.orderBy(F.desc("_r")))).drop("_r")


def _same(a: Column, b: Column) -> Column:
    none = F.array()
    return F.array_sort(F.coalesce(a, none.cast("array<string>"))) == F.array_sort(F.coalesce(b, none.cast("array<string>")))


def metadata_score(cur: str, prev: str) -> Column:
    """Share of the current section hints that the former turn has, if companies, years, quarters and form agree; else 0."""
    c = lambda x, f: F.col(f"{x}.{f}")
    text = lambda a: a.cast("array<string>")
    none = F.array().cast("array<string>")
    hints, before = F.array_distinct(F.coalesce(c(cur, "section_hints"), none)), F.array_distinct(F.coalesce(c(prev, "section_hints"), none))
    ok = (
        c(cur, "companies").eqNullSafe(c(prev, "companies"))
        & _same(text(c(cur, "years")), text(c(prev, "years")))
        & _same(c(cur, "quarters"), c(prev, "quarters"))
        & c(cur, "filing_type_hint").eqNullSafe(c(prev, "filing_type_hint"))
        & (F.size(hints) > 0)
        & (F.size(before) > 0)
    )
    share = F.size(F.array_intersect(hints, before)) / F.size(hints)
    return F.when(F.col(prev).isNull() | F.col(cur).isNull(), 0.0).when(ok, share).otherwise(0.0)


def _meta_key(meta: str) -> Column:
    """A hash that turns with a metadata score above 0 share."""
    c = lambda f: F.col(f"{meta}.{f}")
    none = F.array().cast("array<string>")
    in_order = lambda f: F.array_sort(F.coalesce(c(f).cast("array<string>"), none))
    return F.xxhash64(F.to_json(F.struct(c("companies").alias("c"))), in_order("years"), in_order("quarters"), c("filing_type_hint"))


def reusable(turns: DataFrame, least_sim: float = SIM_THRESHOLD, least_meta: float = META_THRESHOLD) -> DataFrame:
    """id, reuse_id, sim: for each turn the most similar earlier turn of its conversation whose context serves again.

    Of equals the earliest wins. Turns meet only within a conversation and, where a metadata score is asked for, only if
    companies, years, quarters and form agree; both are keys of the join, so pairs that can't count are never made.
    """
    key = _meta_key("parsed_metadata") if least_meta > 0 else F.lit(0)
    t = turns.select("id", "conversation_id", key.alias("k"), "turn_id", F.col("parsed_metadata").alias("meta"), F.col("embedding").alias("vec")).filter("size(vec) > 0")
    prev = t.select(F.col("id").alias("reuse_id"), "conversation_id", "k", F.col("turn_id").alias("prev_turn"), F.col("meta").alias("prev_meta"), F.col("vec").alias("prev_vec"))
    pairs = t.join(prev, ["conversation_id", "k"]).filter("prev_turn < turn_id")
    scored = pairs.select("id", "reuse_id", "prev_turn", cosine(F.col("vec"), F.col("prev_vec")).alias("sim"), metadata_score("meta", "prev_meta").alias("m"))
    best = scored.filter((F.col("sim") >= least_sim) & (F.col("m") >= least_meta))
    return best.groupBy("id").agg(F.max(F.struct("sim", (-F.col("prev_turn")).alias("o"), "reuse_id")).alias("b")).select("id", "b.reuse_id", "b.sim")
