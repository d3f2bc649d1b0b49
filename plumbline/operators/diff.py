"""Rank differences of parent and child lists, sensitivities and paths of single cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT_TYPES = ["Numerical", "Section", "PartyType", "Evidence"]


def case_ranks(results: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distinct cases of the first ``k`` rows of every list with dense ranks; rows without a case are skipped."""
    rows = results.where((F.col("rank") <= k) & F.col("case_id").isNotNull() & (F.col("case_id").cast("string") != ""))
    best = rows.groupBy(*keys, "case_id").agg(F.min("rank").alias("rank"))
    return best.select(*keys, "case_id", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")).alias("rank"))


def displacements(edges: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Long form of every edge's rank differences: one full outer join of parent and child ranks.

    ``edges``: tree_id, node_id, parent_id; ``results``: tree_id, node_id, rank, case_id. A missing rank counts as
    ``k + 1``; edges of which both lists are empty have no rows.
    """
    ranks = case_ranks(results, ["tree_id", "node_id"], k)
    e = edges.select("tree_id", "node_id", "parent_id")
    child = e.join(ranks, ["tree_id", "node_id"]).select("tree_id", "node_id", "case_id", F.col("rank").alias("child_rank"))
    parent = e.join(ranks.withColumnRenamed("node_id", "parent_id"), ["tree_id", "parent_id"]).select("tree_id", "node_id", "case_id", F.col("rank").alias("parent_rank"))
    both = parent.join(child, ["tree_id", "node_id", "case_id"], "full")
    gap = F.abs(F.coalesce("parent_rank", F.lit(k + 1)) - F.coalesce("child_rank", F.lit(k + 1)))
    status = F.when(F.col("child_rank").isNull(), "dropped").when(F.col("parent_rank").isNull(), "new").otherwise("stable")
    return both.select("tree_id", "node_id", "case_id", "parent_rank", "child_rank", gap.cast("long").alias("displacement"), status.alias("status"))


def rank_diff(edges: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Per edge: dropped, new and stable cases in rank order, the displacements and their mean over the union."""

    def ordered(status: str, rank: str):
        kept = F.collect_list(F.when(F.col("status") == status, F.struct(F.col(rank).alias("r"), F.col("case_id").alias("c"))))
        return F.transform(F.array_sort(kept), lambda x: x["c"])

    return displacements(edges, results, k).groupBy("tree_id", "node_id").agg(
        ordered("dropped", "parent_rank").alias("dropped"),
        ordered("new", "child_rank").alias("new"),
        ordered("stable", "parent_rank").alias("stable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("case_id", "displacement")))).alias("rank_displacements"),
        F.avg("displacement").alias("mean_displacement"),
    )


def edge_means(edges: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """tree_id, node_id, mean displacement; edges of which both lists are empty are missing."""
    return displacements(edges, results, k).groupBy("tree_id", "node_id").agg(F.avg("displacement").alias("mean_displacement"))


def sensitivity(edges: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Per tree and fact type: the mean of its edges' means; types without an edge have 0.

    ``edges`` also has fact_type. The grid of trees and types has four rows per tree.
    """
    means = edges.select("tree_id", "node_id", "fact_type").join(edge_means(edges, results, k), ["tree_id", "node_id"])
    types = F.explode(F.array(*[F.lit(t) for t in FACT_TYPES])).alias("fact_type")
    grid = edges.select("tree_id").distinct().select("tree_id", types)
    score = means.groupBy("tree_id", "fact_type").agg(F.avg("mean_displacement").alias("s"))
    return grid.join(score, ["tree_id", "fact_type"], "left").select("tree_id", "fact_type", F.coalesce("s", F.lit(0.0)).alias("sensitivity"))


def most_operative(scores: DataFrame) -> DataFrame:
    """Per tree: the fact type with the greatest sensitivity, ties in the order of the types."""
    place = -F.array_position(F.array(*[F.lit(t) for t in FACT_TYPES]), F.col("fact_type"))
    best = F.max_by(F.struct("fact_type", "sensitivity"), F.struct("sensitivity", place.alias("p"))).alias("m")
    return scores.groupBy("tree_id").agg(best).select("tree_id", "m.fact_type", "m.sensitivity")


def case_path(edges: DataFrame, results: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """For each wanted (tree_id, case_id): its ranks, displacement and status along every edge where it appears."""
    return displacements(edges, results, k).join(cases.select("tree_id", "case_id").distinct(), ["tree_id", "case_id"], "left_semi")


def diff_table(edges: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Rows as a viewer shows them: parents' cases first, then new ones; missing ranks as a dash; position from 1."""
    rows = displacements(edges, results, k)
    place = F.coalesce("parent_rank", 1000 + F.col("child_rank"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    order = Window.partitionBy("tree_id", "node_id").orderBy(place)
    return rows.select("tree_id", "node_id", "case_id", shown("parent_rank"), shown("child_rank"), "displacement", "status", F.row_number().over(order).alias("position"))
