"""Pairing deletions with insertions of equal content, on candidates, without listing a group's members in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relomap.operators.groups import group_counts
from relomap.tables import with_ordinals


def _sides(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    live = candidates.where("active") if "active" in candidates.columns else candidates
    return live.where("kind = 'delete'"), live.where("kind = 'insert'")


def greedy_pairs(candidates: DataFrame, key: str = "canonical_text", id_col: str = "candidate_id") -> DataFrame:
    """``del_id``, ``ins_id``: within each content the n-th deletion with the n-th insertion, by id.

    Rows that can pair are numbered in one range sort by (content, side, id), and a row's rank is its number less the
    first of its content and side; so a content that holds a third of all rows is ranked by many tasks.
    """
    live = candidates.where("active") if "active" in candidates.columns else candidates
    two = group_counts(candidates, key, id_col).where("dels > 0 AND ins > 0").select(key, F.least("dels", "ins").alias("_pairs"))
    numbered = with_ordinals(live.select(key, "kind", id_col).join(two, key), (key, "kind", id_col), "_number")
    firsts = numbered.groupBy(key, "kind").agg(F.min("_number").alias("_first"))
    ranked = numbered.join(firsts, [key, "kind"]).withColumn("_rank", F.col("_number") - F.col("_first")).where(F.col("_rank") < F.col("_pairs"))
    paired = ranked.groupBy(key, "_rank").agg(F.max(F.when(F.col("kind") == "delete", F.col(id_col))).alias("del_id"), F.max(F.when(F.col("kind") == "insert", F.col(id_col))).alias("ins_id"))
    return paired.select("del_id", "ins_id")


def all_pairs(candidates: DataFrame, cap: int | None, key: str = "canonical_text", id_col: str = "candidate_id") -> DataFrame:
    """``del_id``, ``ins_id``: every deletion with every insertion of equal content.

    The pairs of a content are as many as the product of its sides, so a caller must say how many there may be, or None for
    all. With ``cap``, contents are taken in order of their first member as long as the pairs so far do not pass the cap; the
    first two-sided content that would ends the list, and its pairs are left out whole.
    """
    deletes, inserts = _sides(candidates)
    chosen = group_counts(candidates, key, id_col).where("dels > 0 AND ins > 0")
    if cap is not None:
        # Each content has a pair at least, so those past the cap-th cannot be in: the running sum is over cap rows at most.
        first = chosen.orderBy("first_id").limit(max(cap, 0))
        pairs = F.col("dels").cast("decimal(38,0)") * F.col("ins")
        running = F.sum(pairs).over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, 0))
        chosen = first.withColumn("_sum", running).where(F.col("_sum") <= cap)
    kept = chosen.select(key)
    left = deletes.join(kept, key, "left_semi").select(key, F.col(id_col).alias("del_id"))
    right = inserts.join(kept, key, "left_semi").select(key, F.col(id_col).alias("ins_id"))
    return left.join(right, key).select("del_id", "ins_id")


def unmatched(candidates: DataFrame, pairs: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Active candidates that no pair holds."""
    live = candidates.where("active") if "active" in candidates.columns else candidates
    taken = pairs.select(F.explode(F.array("del_id", "ins_id")).alias(id_col))
    return live.join(taken, id_col, "left_anti")
