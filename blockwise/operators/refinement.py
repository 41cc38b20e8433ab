"""Second looks at mixed clusters: reports of a refinement, and the summary over many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage
from blockwise.operators import metrics as mt
from blockwise.operators.analysis import refinement_ranking, replaced_clusters
from blockwise.operators.labels import normalized_groups

SUMMARY = ["average_pairwise_precision", "average_pairwise_recall", "average_pairwise_f1", "fully_covered_authors", "total_authors", "complete_author_coverage"]


def refined_parents(truth: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parent_index, papers, authors, child_clusters, pairwise scores): each refined parent, judged by its own
    papers with a known author alone. ``children`` has keys, parent_index, child_index and paper_id."""
    both = [*keys, "parent_index"]
    inside = cut_lineage(children.select(*both, "paper_id", F.col("child_index").cast("string").alias("label")).distinct())
    known = inside.select(*both, "paper_id").distinct().join(truth.select(*keys, "paper_id", "label"), [*keys, "paper_id"])
    table = cut_lineage(mt.contingency(known, inside, both))
    shape = table.groupBy(*both).agg(F.countDistinct("t").alias("authors"), F.countDistinct("p").alias("child_clusters"))
    return mt.pairwise(table, both).join(shape, both)


def refinement_report(truth: DataFrame, clusters: DataFrame, children: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the clustering after refined parents are replaced by their children, missing papers as singletons.

    Means of precision, recall and F1 over blocks, fully covered and all authors over all blocks with their ratio, and
    the number of refined parents. Without any block means are null.
    """
    merged = replaced_clusters(clusters.select(*keys, "cluster_index", "paper_id"), children, keys)
    merged = cut_lineage(merged.select(*keys, F.col("cluster").alias("cluster_index"), "paper_id", F.lit(0).alias("pos")))
    known = truth.join(universe.select(*keys, "paper_id").distinct(), [*keys, "paper_id"], "left_semi")
    p = mt.pairwise(mt.contingency(known, normalized_groups(merged, universe, keys), keys), keys)
    cov = mt.complete_author_coverage(known, merged, keys)
    per = p.join(cov, keys, "full")
    refined = children.select(*keys, "parent_index").distinct().agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.avg("pairwise_precision").alias(SUMMARY[0]), F.avg("pairwise_recall").alias(SUMMARY[1]), F.avg("pairwise_f1").alias(SUMMARY[2]),
        F.sum("fully_covered_authors").alias(SUMMARY[3]), F.sum("total_authors").alias(SUMMARY[4]), F.try_divide(F.sum("fully_covered_authors").cast("double"), F.sum("total_authors").cast("double")).alias(SUMMARY[5]),
    ).withColumn("refined_parent_clusters", refined.scalar())


def all_combinations(requested: DataFrame, discovered: DataFrame, column: str = "combination") -> DataFrame:
    """(combination): those asked for and those of which results were found, each once."""
    return requested.select(column).union(discovered.select(column)).distinct()


def sweep_summary(requested: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per combination asked for or found: status completed or not_run, its report and its rank.

    ``reports`` has combination and the columns of ``refinement_report``. Completed ones come first, then by F1 and
    precision; zero and null count as least. Combinations are few.
    """
    every = all_combinations(requested, reports).join(reports, "combination", "left")
    done = F.col("total_authors").isNotNull()
    least = lambda c: F.nullif(F.col(c), F.lit(0.0))
    marked = every.withColumn("status", F.when(done, "completed").otherwise("not_run")).withColumns({"_d": done.cast("int"), "_f": least(SUMMARY[2]), "_p": least(SUMMARY[0])})
    return refinement_ranking(marked, "_d", "_f", "_p").drop("_d", "_f", "_p")
