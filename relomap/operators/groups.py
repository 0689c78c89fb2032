"""Content groups: deletions and insertions of equal content.

A group is one row. Its ids are kept as arrays where a caller needs them (``content_groups``); counts and kinds alone
(``group_counts``) are aggregated with map-side combining and never hold the members, which is what wide inputs want.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relomap.model import GROUP_KINDS
from relomap.tables import with_ordinals


def classify(deletes: Column, inserts: Column) -> Column:
    """Kind of a group from the numbers of its deletions and insertions."""
    return (
        F.when((deletes == 0) & (inserts == 0), "ambiguous")
        .when(inserts == 0, "delete_only")
        .when(deletes == 0, "insert_only")
        .when((deletes == 1) & (inserts == 1), "move_1_to_1")
        .when(deletes == inserts, "moves_many")
        .otherwise("copy_or_repeat")
    )


def group_counts(candidates: DataFrame, key: str = "canonical_text", id_col: str = "candidate_id") -> DataFrame:
    """One row per content: the key, ``dels``, ``ins``, ``first_id`` and ``kind``. Inactive candidates are passed over."""
    live = candidates.where("active") if "active" in candidates.columns else candidates
    grouped = live.groupBy(key).agg(F.count_if(F.col("kind") == "delete").alias("dels"), F.count_if(F.col("kind") == "insert").alias("ins"), F.min(id_col).alias("first_id"))
    return grouped.withColumn("kind", classify(F.col("dels"), F.col("ins")))


def content_groups(candidates: DataFrame, key: str = "canonical_text", id_col: str = "candidate_id", confirmed: bool = True) -> DataFrame:
    """``group_id`` (order of first member, from 0), the key, ``del_ids``, ``ins_ids`` (ascending), ``kind``.

    Unconfirmed groups take the key as it is, a hash that may collide, and do not pass over inactive candidates.
    """
    live = candidates.where("active") if confirmed and "active" in candidates.columns else candidates
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col(id_col))))
    grouped = live.groupBy(key).agg(side("delete").alias("del_ids"), side("insert").alias("ins_ids"), F.min(id_col).alias("_first"))
    grouped = grouped.withColumn("kind", classify(F.size("del_ids"), F.size("ins_ids")))
    return with_ordinals(grouped, ("_first",), "group_id").drop("_first")


def kind_histogram(groups: DataFrame) -> DataFrame:
    """``kind``, ``groups``: how many groups there are of each kind."""
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"))


def registry_summary(groups: DataFrame) -> DataFrame:
    """One row over ``group_counts``: groups, ids by side, and a count for each kind."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in GROUP_KINDS]
    return groups.agg(F.count(F.lit(1)).alias("content_groups"), F.coalesce(F.sum("dels"), F.lit(0)).alias("delete_ids"), F.coalesce(F.sum("ins"), F.lit(0)).alias("insert_ids"), *kinds)


def top_buckets(groups: DataFrame, key: str, most: int) -> DataFrame:
    """The largest contents of ``group_counts``, ties to the lesser key: with ``members`` and ``not_shown``, the rest's number."""
    sized = groups.withColumn("members", F.col("dels") + F.col("ins"))
    total = groups.agg(F.count(F.lit(1)).alias("_total"))
    top = sized.orderBy(F.col("members").desc(), F.col(key)).limit(most)
    return top.crossJoin(F.broadcast(total)).withColumn("not_shown", F.greatest(F.col("_total") - most, F.lit(0))).drop("_total", "first_id")


def first_groups(groups: DataFrame, most: int, preview: int) -> DataFrame:
    """The first groups of ``content_groups`` with at most ``preview`` ids a side and how many more there are."""
    shown = groups.orderBy("group_id").limit(most)
    for side in ("del_ids", "ins_ids"):
        shown = shown.withColumns({f"{side}_more": F.greatest(F.size(side) - preview, F.lit(0)), side: F.slice(side, 1, preview)})
    return shown


def move_summary(regions_total: Column, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: ``move_count`` (two-sided groups), ``annotated_regions`` (twice that, as the summary file has it),
    ``annotated_regions_actual`` (members of two-sided groups), ``candidates_total``, ``groups_total``."""
    two = (F.col("dels") > 0) & (F.col("ins") > 0)
    totals = groups.agg(
        F.count_if(two).alias("move_count"),
        (F.count_if(two) * 2).alias("annotated_regions"),
        F.coalesce(F.sum(F.when(two, F.col("dels") + F.col("ins"))), F.lit(0)).alias("annotated_regions_actual"),
        F.count(F.lit(1)).alias("groups_total"),
    )
    live = candidates.where("active") if "active" in candidates.columns else candidates
    return totals.crossJoin(live.agg(F.count(F.lit(1)).alias("candidates_total"))).withColumn("regions_total", regions_total)
