"""Quality of a clustering: pairwise and B-cubed scores, coverage, compositions, cluster shapes.

Inputs are labelled papers: frames (keys..., paper_id, label). All pair counts come from closed forms over the
contingency table; no pair is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.functions.text import harmonic, ratio


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def contingency(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, p, n, ts, ps): papers by true and predicted label, with the sizes of both over the joined papers."""
    cell = truth.select(*keys, "paper_id", F.col("label").alias("t")).join(predicted.select(*keys, "paper_id", F.col("label").alias("p")), [*keys, "paper_id"]).groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    ts = cell.groupBy(*keys, "t").agg(F.sum("n").alias("ts"))
    ps = cell.groupBy(*keys, "p").agg(F.sum("n").alias("ps"))
    return cell.join(ts, [*keys, "t"]).join(ps, [*keys, "p"])


def pairwise(table: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise precision, recall and F1 per clustering, 0 where a denominator is 0.

    The pairs of a group of size s are the sum of n (s - 1) / 2 over its cells, so one pass over the cells gives all three.
    """
    s = table.groupBy(*keys).agg(F.sum(pairs_of(F.col("n"))).alias("tp"), F.sum(F.col("n") * (F.col("ts") - 1) / 2).alias("tt"), F.sum(F.col("n") * (F.col("ps") - 1) / 2).alias("pp"), F.sum("n").alias("papers"))
    p, r = ratio(F.col("tp"), F.col("pp")), ratio(F.col("tp"), F.col("tt"))
    return s.select(*keys, "papers", p.alias("pairwise_precision"), r.alias("pairwise_recall"), harmonic(p, r).alias("pairwise_f1"))


def b_cubed(table: DataFrame, keys: list[str]) -> DataFrame:
    """B-cubed precision, recall and F1 per clustering."""
    s = table.groupBy(*keys).agg((F.sum(F.col("n") * F.col("n") / F.col("ps")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("n") / F.col("ts")) / F.sum("n")).alias("r"))
    return s.select(*keys, F.col("p").alias("b3_precision"), F.col("r").alias("b3_recall"), harmonic(F.col("p"), F.col("r")).alias("b3_f1"))


def scores(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise and B-cubed scores, number of true and predicted clusters and their difference, one row per clustering."""
    from blockwise.common import cut_lineage

    t = cut_lineage(contingency(truth, predicted, keys))  # read by three aggregates
    n = t.groupBy(*keys).agg(F.countDistinct("t").alias("true_clusters"), F.countDistinct("p").alias("predicted_clusters"))
    return pairwise(t, keys).join(b_cubed(t, keys), keys).join(n, keys).withColumn("cluster_count_bias", F.col("predicted_clusters") - F.col("true_clusters"))


def author_coverage(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, author, papers, best_cluster_papers, best_cluster_ratio, fully_covered), one row per true author.

    Papers count in every cluster that holds them. An author none of whose papers is returned has best 0.
    """
    size = truth.groupBy(*keys, F.col("label").alias("author")).agg(F.countDistinct("paper_id").alias("papers"))
    cell = truth.select(*keys, "paper_id", F.col("label").alias("author")).join(clusters.select(*keys, "cluster_index", "paper_id").distinct(), [*keys, "paper_id"]).groupBy(*keys, "author", "cluster_index").agg(F.count(F.lit(1)).alias("n"))
    best = cell.groupBy(*keys, "author").agg(F.max("n").alias("best"))
    b = F.coalesce("best", F.lit(0))
    return size.join(best, [*keys, "author"], "left").select(*keys, "author", "papers", b.alias("best_cluster_papers"), (b / F.col("papers")).alias("best_cluster_ratio"), (b == F.col("papers")).alias("fully_covered"))


def complete_author_coverage(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fully_covered_authors, total_authors, rate)."""
    c = author_coverage(truth, clusters, keys)
    full = F.count_if("fully_covered")
    return c.groupBy(*keys).agg(full.alias("fully_covered_authors"), F.count(F.lit(1)).alias("total_authors"), (full / F.count(F.lit(1))).alias("rate"))


def compositions(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_index, author, n): how many papers of each author a cluster holds; repeated ids count once."""
    return clusters.select(*keys, "cluster_index", "paper_id").distinct().join(truth.select(*keys, "paper_id", F.col("label").alias("author")), [*keys, "paper_id"]).groupBy(*keys, "cluster_index", "author").agg(F.count(F.lit(1)).alias("n"))


def composition_maps(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_index, composition): the same as one map per cluster."""
    return compositions(truth, clusters, keys).groupBy(*keys, "cluster_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "n")))).alias("composition"))


def duplicates(clusters: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(within: keys, cluster_index, paper_id, times), (across: keys, paper_id, cluster_indexes as text)."""
    within = clusters.groupBy(*keys, "cluster_index", "paper_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    across = clusters.select(*keys, "paper_id", "cluster_index").distinct().groupBy(*keys, "paper_id").agg(F.array_sort(F.collect_list("cluster_index")).alias("c")).where("size(c) > 1")
    return within, across.select(*keys, "paper_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("cluster_indexes"))


def coarse_report(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Covered authors and their share, clusters, the largest cluster and its share of the true papers."""
    cov = complete_author_coverage(truth, clusters, keys)
    sizes = clusters.select(*keys, "cluster_index", "paper_id").distinct().groupBy(*keys, "cluster_index").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("coarse_clusters"), F.max("n").alias("largest_cluster"))
    total = truth.groupBy(*keys).agg(F.countDistinct("paper_id").alias("all_papers"))
    return cov.join(shape, keys, "left").join(total, keys).select(
        *keys, F.col("fully_covered_authors").alias("real_authors_fully_covered"), F.col("total_authors").alias("real_authors_total"), F.col("rate").alias("coarse_recall"),
        F.coalesce("coarse_clusters", F.lit(0)).alias("coarse_clusters"), F.coalesce("largest_cluster", F.lit(0)).alias("largest_cluster"), (F.coalesce("largest_cluster", F.lit(0)) / F.col("all_papers")).alias("largest_cluster_ratio"))


def missing_by_author(truth: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, author, n_missing): papers with a known author that no cluster holds."""
    return truth.join(clusters.select(*keys, "paper_id").distinct(), [*keys, "paper_id"], "left_anti").groupBy(*keys, F.col("label").alias("author")).agg(F.countDistinct("paper_id").alias("n_missing"))


def cluster_analysis(truth: DataFrame, clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """One row per clustering: clusters, valid, missing, unknown and repeated papers, pairwise scores with missing papers
    as singletons, and complete author coverage."""
    from blockwise.operators.labels import normalized_groups, violations

    v = violations(clusters, universe, keys)
    within = clusters.groupBy(*keys, "cluster_index", "paper_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("within_cluster_duplicates"))
    valid = clusters.select(*keys, "paper_id").distinct().join(universe.select(*keys, "paper_id").distinct(), [*keys, "paper_id"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("returned_valid_papers"))
    known = truth.join(universe.select(*keys, "paper_id").distinct(), [*keys, "paper_id"], "left_semi")
    p = pairwise(contingency(known, normalized_groups(clusters, universe, keys), keys), keys)
    cov = complete_author_coverage(known, clusters, keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return v.join(within, keys, "left").join(valid, keys, "left").join(p, keys, "left").join(cov, keys, "left").select(
        *keys, F.col("n_clusters").alias("llm_clusters"), zero("returned_valid_papers"), F.col("n_missing").alias("missing_papers"), F.col("n_unknown").alias("unknown_papers"), F.col("n_repeated").alias("cross_cluster_duplicates"),
        zero("within_cluster_duplicates"), "pairwise_precision", "pairwise_recall", "pairwise_f1", "fully_covered_authors", "total_authors", F.col("rate").alias("complete_author_coverage"))


def cluster_statistics(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster count, share of singletons, share of the largest cluster and entropy (base 2) of the sizes."""
    sizes = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("s"))
    total = sizes.groupBy(*keys).agg(F.sum("s").alias("papers"))
    share = F.col("s") / F.col("papers")
    return sizes.join(total, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cluster_count"), (F.count_if(F.col("s") == 1) / F.count(F.lit(1))).alias("singleton_ratio"), F.max(share).alias("largest_cluster_ratio"), (-F.sum(share * F.log2(share))).alias("size_entropy"))


def cluster_count_ratio(true: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_count_ratio, log2_cluster_count_ratio, cluster_count_bias) from two ``cluster_statistics``."""
    t = true.select(*keys, F.col("cluster_count").alias("tc"))
    p = predicted.select(*keys, F.col("cluster_count").alias("pc"))
    r = F.try_divide(F.col("pc").cast("double"), F.col("tc").cast("double"))
    return t.join(p, keys).select(*keys, r.alias("cluster_count_ratio"), F.log2(r).alias("log2_cluster_count_ratio"), (F.col("pc") - F.col("tc")).alias("cluster_count_bias"))


def macro_average(per_block: DataFrame, metric: str = "pairwise_f1") -> DataFrame:
    """One row: the mean of the metric over blocks, 0.0 if there is none, and the number of blocks."""
    return per_block.agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias("macro_average"), F.count(metric).alias("blocks"))


def partial_evaluation(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scores of blocks all of whose true papers are predicted, one row with evaluated and skipped counts).

    Blocks predicted without truth, and blocks with an unpredicted true paper, are skipped and counted.
    """
    pred = predicted.select(*keys, "paper_id").distinct().withColumn("got", F.lit(1))
    gaps = truth.join(pred, [*keys, "paper_id"], "left").groupBy(*keys).agg(F.count_if(F.col("got").isNull()).alias("gaps"), F.count(F.lit(1)).alias("n"))
    whole = gaps.where("gaps = 0").select(*keys)
    table = contingency(truth.join(whole, keys, "left_semi"), predicted, keys)
    named = predicted.select(*keys).distinct()
    no_truth = named.join(truth.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("without_truth"))
    predicted_gaps = gaps.join(named, keys, "left_semi")
    counts = predicted_gaps.agg(F.count_if(F.col("gaps") == 0).alias("evaluated"), F.count_if(F.col("gaps") > 0).alias("incomplete"))
    return pairwise(table, keys), counts.withColumn("without_truth", no_truth.scalar())


def metric_mart(truth: DataFrame, clusters: DataFrame, blocks: DataFrame, coverages: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected block with status completed, missing_result or error, all scores, shapes and coverages.

    A block is in error if its result names unknown papers or puts a paper in several clusters; an error does not touch
    the other rows.
    """
    from blockwise.common import cut_lineage
    from blockwise.operators.labels import normalized_groups, violations

    keys = ["name"]
    clusters, blocks, truth = cut_lineage(clusters), cut_lineage(blocks), cut_lineage(truth)
    v = violations(clusters, blocks, keys).join(clusters.select("name").distinct().withColumn("has", F.lit(1)), "name", "left")
    good = v.where("has = 1 and n_unknown = 0 and n_repeated = 0").select("name")
    pred = cut_lineage(normalized_groups(clusters.join(good, "name", "left_semi"), blocks.join(good, "name", "left_semi"), keys))
    s = scores(truth, pred, keys)
    ts, ps = cluster_statistics(truth, keys), cluster_statistics(pred, keys)
    tcols = ts.select("name", F.col("singleton_ratio").alias("true_singleton_ratio"), F.col("largest_cluster_ratio").alias("true_largest_cluster_ratio"), F.col("size_entropy").alias("true_cluster_size_entropy"))
    pcols = ps.select("name", F.col("singleton_ratio").alias("predicted_singleton_ratio"), F.col("largest_cluster_ratio").alias("predicted_largest_cluster_ratio"))
    reason = F.when(F.col("n_unknown") > 0, F.lit("unknown papers")).when(F.col("n_repeated") > 0, F.lit("papers in multiple clusters"))
    status = F.when(F.col("has").isNull(), "missing_result").when(reason.isNotNull(), "error").otherwise("completed")
    m = expected.select("name").distinct().join(v, "name", "left").withColumn("status", status).withColumn("error_reason", F.when(F.col("status") == "error", reason))
    ratio_cols = cluster_count_ratio(ts, ps, keys).drop("cluster_count_bias")
    return m.select("name", "status", "error_reason").join(coverages, "name", "left").join(s.drop("papers"), "name", "left").join(ratio_cols, "name", "left").join(tcols, "name", "left").join(pcols, "name", "left")
