"""The latest version of each text, without moving texts whose id stands once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import staged

MOST_IDS = 1_000_000  # repeated ids that are broadcast, at most; more are joined by a shuffle


def latest_texts(rows: DataFrame) -> DataFrame:
    """id, t: of rows id, v, t the one with the greatest v for each id; at equal versions the greatest text. Null ids are left out.

    Ids are counted first, without their texts. Texts of ids that stand once stay where they are read; only those of repeated
    ids are grouped, by partial aggregation, so an id with a third of all rows costs no task more than its share.
    """
    rows = rows.select("id", "v", "t").filter("id IS NOT NULL")
    repeated = staged(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-ids")
    ids = F.broadcast(repeated) if repeated.count() <= MOST_IDS else repeated
    once = rows.join(ids, "id", "left_anti").select("id", "t")
    many = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.max(F.struct("v", "t")).alias("r")).select("id", F.col("r.t").alias("t"))
    return once.unionByName(many)
