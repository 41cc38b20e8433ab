"""Summaries over runs, conditions and combinations; repair counts; rankings and systematic samples."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, numbered_within, weighted_rank
from blockwise.operators.similarity import each_pair, tile_pairs


def combination_summary(rows: DataFrame, metrics: list[str], by: str = "field_combination") -> DataFrame:
    """Per combination: number of rows and mean, median, min and max of each metric."""
    aggs = [F.count(F.lit(1)).alias("completed_author_blocks")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"macro_average_{m}"), F.percentile(m, F.lit(0.5)).alias(f"median_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return rows.groupBy(by).agg(*aggs)


def with_macro_row(detail: DataFrame, metrics: list[str], by: str = "field_combination", block: str = "name") -> DataFrame:
    """The detail rows and, per combination, a row "MACRO_AVERAGE" with the means."""
    macro = detail.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(block, F.lit("MACRO_AVERAGE"))
    return detail.select(by, block, *metrics).unionByName(macro.select(by, block, *metrics))


def with_total_rows(rows: DataFrame, counters: list[str], by: str = "field_added", block: str = "author_block") -> DataFrame:
    """The rows per block and, per field, a row "ALL" with the sums."""
    total = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in counters]).withColumn(block, F.lit("ALL"))
    return rows.select(by, block, *counters).unionByName(total.select(by, block, *counters))


def repair_counts(truth: DataFrame, without: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Per block: false splits and merges fixed and introduced by the full prediction, unchanged pairs and the net gain.

    Inputs are labelled papers. Every count is a sum of n (n - 1) / 2 over groups of papers with equal labels, taken
    with inclusion and exclusion over the three labellings; no pair is made.
    """
    lab = truth.select(*keys, "paper_id", F.col("label").alias("t")).join(without.select(*keys, "paper_id", F.col("label").alias("w")), [*keys, "paper_id"]).join(full.select(*keys, "paper_id", F.col("label").alias("f")), [*keys, "paper_id"])
    cells = lab.groupBy(*keys, "t", "w", "f").agg(F.count(F.lit(1)).alias("k"))

    def same(columns: list[str], out: str) -> DataFrame:
        g = cells.groupBy(*keys, *columns).agg(F.sum("k").alias("n"))
        return g.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias(out))

    parts = [same(c, "s_" + "".join(c)) for c in ([], ["w"], ["f"], ["t", "w"], ["t", "f"], ["w", "f"], ["t", "w", "f"])]
    s = reduce(lambda a, b: a.join(b, keys), parts)
    c = F.col
    fixed_split, fixed_merge = c("s_tf") - c("s_twf"), c("s_w") - c("s_tw") - c("s_wf") + c("s_twf")
    new_split, new_merge = c("s_tw") - c("s_twf"), c("s_f") - c("s_tf") - c("s_wf") + c("s_twf")
    out = s.select(*keys, fixed_split.alias("fixed_false_splits"), fixed_merge.alias("fixed_false_merges"), new_split.alias("introduced_false_splits"), new_merge.alias("introduced_false_merges"), c("s_").alias("_all"))
    changed = c("fixed_false_splits") + c("fixed_false_merges") + c("introduced_false_splits") + c("introduced_false_merges")
    return out.select(*keys, "fixed_false_splits", "fixed_false_merges", "introduced_false_splits", "introduced_false_merges", (c("_all") - changed).alias("unchanged_pairs"),
                      (c("fixed_false_splits") + c("fixed_false_merges") - c("introduced_false_splits") - c("introduced_false_merges")).alias("net_pairwise_gain"))


def change_type(gt_same: Column, without_same: Column, full_same: Column) -> Column:
    """What a prediction changed about one pair."""
    return (
        F.when(without_same == full_same, "unchanged").when(gt_same & ~without_same & full_same, "fixed_false_split").when(~gt_same & without_same & ~full_same, "fixed_false_merge")
        .when(gt_same & without_same & ~full_same, "introduced_false_split").otherwise("introduced_false_merge"))


def _labelled(papers: DataFrame, without: DataFrame, full: DataFrame) -> DataFrame:
    """(name, i, paper_id, author, w, f): authors and both labels as hashes; for papers that have all three."""
    lab = papers.select("name", "i", "paper_id", F.xxhash64("author").alias("author"))
    for labels, tag in ((without, "w"), (full, "f")):
        lab = lab.join(labels.select("name", "paper_id", F.xxhash64("label").alias(tag)), ["name", "paper_id"])
    return cut_lineage(lab.select("name", "i", "paper_id", "author", "w", "f"))


_CHANGED_SCHEMA = "author_block string, paper_i string, paper_j string, change_type string"


def _parted(other: str, types: tuple[str, str]):
    """Pairs whose labels in ``other`` differ, with the type for equal and for different authors."""

    def run(batches):
        for batch, k, x, y, at in each_pair(batches):
            own, later = at // y.n, at % y.n
            changed = x.get(other)[own] != y.get(other)[later]
            own, later = own[changed], later[changed]
            if len(own):
                same = x.get("author")[own] == y.get("author")[later]
                block = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), pa.array([batch.column("name")[k].as_py()]))
                kind = pa.DictionaryArray.from_arrays(pa.array((~same).astype(np.int32)), pa.array(types))
                yield pa.RecordBatch.from_arrays([block.dictionary_decode(), x.field["paper_id"].take(pa.array(own)), y.field["paper_id"].take(pa.array(later)), kind.dictionary_decode()], names=[c.split()[0] for c in _CHANGED_SCHEMA.split(", ")])

    return run


def changed_pairs(papers: DataFrame, without: DataFrame, full: DataFrame) -> DataFrame:
    """(author_block, paper_i, paper_j, change_type): pairs whose prediction differs between two labellings.

    ``papers`` has name, i (the place in the block), paper_id and author. Such a pair has one label in common, so only
    papers with equal labels are compared, tile by tile; no pair is shuffled.
    """
    lab = _labelled(papers, without, full)
    out = None
    for label, other, types in (("f", "w", ("fixed_false_split", "introduced_false_merge")), ("w", "f", ("introduced_false_split", "fixed_false_merge"))):
        placed = numbered_within(lab, ["name", label], ["i"], "place").select("name", label, F.col("place").alias("i"), "paper_id", "author", other)
        part = tile_pairs(placed, ["name", label], ["i", "paper_id", "author", other]).mapInArrow(_parted(other, types), _CHANGED_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def first_changed_pairs(papers: DataFrame, without: DataFrame, full: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first few of ``changed_pairs`` by block and ids per change type, with their ``place``, without making the others.

    How many pairs of a type a paper begins follows from the numbers of later papers with the same labels. The first
    pairs begin with the first papers that begin any; only those papers are held against the later ones of their block.
    """
    lab = _labelled(papers, without, full)
    later = lambda *keys: F.row_number().over(Window.partitionBy("name", *keys).orderBy(F.col("i").desc())) - 1
    groups = [("author", "f"), ("author", "w", "f"), ("author", "w"), ("w", "f"), ("w",), ("f",)]
    n = lab.select("*", *[later(*g).alias("n_" + "".join(x[0] for x in g)) for g in groups])
    c = F.col
    counts = {
        "fixed_false_split": c("n_af") - c("n_awf"), "fixed_false_merge": c("n_w") - c("n_aw") - c("n_wf") + c("n_awf"),
        "introduced_false_split": c("n_aw") - c("n_awf"), "introduced_false_merge": c("n_f") - c("n_af") - c("n_wf") + c("n_awf")}
    begun = n.select("name", "i", "paper_id", "author", "w", "f", F.explode(F.array(*[F.struct(F.lit(t).alias("change_type"), x.alias("c")) for t, x in counts.items()])).alias("s")).where("s.c > 0")
    begun = begun.select("name", "i", "paper_id", "author", "w", "f", "s.change_type")
    first = begun.withColumn("_r", F.row_number().over(Window.partitionBy("change_type").orderBy("name", "paper_id"))).where(F.col("_r") <= max(limits.values()))
    a, b = F.broadcast(first).alias("a"), lab.alias("b")
    found = b.join(a, (c("a.name") == c("b.name")) & (c("a.i") < c("b.i")) & (change_type(c("a.author") == c("b.author"), c("a.w") == c("b.w"), c("a.f") == c("b.f")) == c("a.change_type")))
    pairs = found.select(c("a.name").alias("author_block"), c("a.paper_id").alias("paper_i"), c("b.paper_id").alias("paper_j"), c("a.change_type").alias("change_type"))
    return example_cases(pairs, limits, ["author_block", "paper_i", "paper_j"])


def baseline_delta(rows: DataFrame, metric: str, baseline: str, by: str = "name", condition: str = "condition") -> DataFrame:
    """Per block and condition: the mean over repetitions, the baseline's and the difference."""
    mean = rows.groupBy(by, condition).agg(F.avg(metric).alias("value"))
    base = mean.where(F.col(condition) == baseline).select(by, F.col("value").alias("baseline"))
    return mean.join(base, by, "left").withColumn("delta", F.col("value") - F.col("baseline"))


def condition_summary(rows: DataFrame, metric: str, baseline: str, empty: float | None = 0.0) -> DataFrame:
    """Per condition: mean and median of the per-block means, mean and median difference to the baseline, failures, and
    how many blocks improved, got worse or stayed (within 1e-12). Without any value means are ``empty``."""
    d = baseline_delta(rows, metric, baseline)
    fails = rows.groupBy("condition").agg(F.count_if(F.col(metric).isNull()).alias("parse_failure_count"))
    fill = (lambda c: F.coalesce(c, F.lit(empty))) if empty is not None else (lambda c: c)
    x = F.col("delta")
    s = d.groupBy("condition").agg(
        fill(F.avg("value")).alias(f"mean_{metric}"), fill(F.percentile("value", F.lit(0.5))).alias(f"median_{metric}"), fill(F.avg("delta")).alias("mean_delta"), fill(F.percentile("delta", F.lit(0.5))).alias("median_delta"),
        F.count_if(x > 1e-12).alias("improved"), F.count_if(x < -1e-12).alias("degraded"), F.count_if(F.abs(x) <= 1e-12).alias("unchanged"))
    return s.join(fails, "condition")


def prompt_summary(rows: DataFrame, metrics: list[str], conditions: list[str]) -> DataFrame:
    """Per condition of a fixed list: mean of each metric and median of the first over successful runs, null where there
    is none, and the number of failures. ``rows`` has condition, parse_success and the metrics."""
    ok = F.col("parse_success")
    good = lambda m: F.when(ok, F.col(m))
    s = rows.groupBy("condition").agg(*[F.avg(good(m)).alias(f"mean_{m}") for m in metrics], F.percentile(good(metrics[0]), F.lit(0.5)).alias(f"median_{metrics[0]}"), F.count_if(~ok).alias("parse_failure_count"))
    every = rows.sparkSession.createDataFrame([(c,) for c in conditions], "condition string")
    return every.join(s, "condition", "left").withColumn("parse_failure_count", F.coalesce("parse_failure_count", F.lit(0)))


def prompt_deltas(rows: DataFrame, metrics: list[str], baseline: str = "minimal", block: str = "name") -> DataFrame:
    """Per block and other condition, where both were successful: value, baseline value and difference of each metric."""
    ok = rows.where("parse_success").select(block, "condition", *metrics)
    base = ok.where(F.col("condition") == baseline).select(block, *[F.col(m).alias(f"{baseline}_{m}") for m in metrics])
    other = ok.where(F.col("condition") != baseline).join(base, block)
    return other.select(block, "condition", *[c for m in metrics for c in (F.col(f"{baseline}_{m}"), F.col(m).alias(f"condition_{m}"), (F.col(m) - F.col(f"{baseline}_{m}")).alias(f"delta_{m}"))])


def condition_matrix(rows: DataFrame, metric: str, conditions: list[str], by: str = "name") -> DataFrame:
    """One row per block and a column per condition: the mean of the metric, null where there is none."""
    return rows.groupBy(by).pivot("condition", conditions).agg(F.avg(metric))


def complete_run_summary(per_run: DataFrame, metrics: list[str], expected: int) -> DataFrame:
    """(metric, runs, mean, deviation, minimum, maximum) over runs with all ``expected`` names; deviation is the
    population's. ``per_run`` comes from ``run_summary``."""
    long = per_run.where(F.col("names") == expected).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.count("v").alias("runs"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def example_cases(changed: DataFrame, limits: dict[str, int], order: list[str], kind: str = "change_type") -> DataFrame:
    """The first few rows of each change type in the given order; other types give none."""
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(kind).orderBy(*order)
    few = changed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(limits.values()))
    return few.where(F.col("place") <= F.coalesce(F.try_element_at(most, kind), F.lit(0)))


def repeat_stability(rows: DataFrame, metric: str, by: str = "name", repetition: str = "repetition") -> DataFrame:
    """Per block: mean, population standard deviation, min, max and range over repetitions, and their number."""
    return rows.where(F.col(metric).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("repetitions"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("standard_deviation"), F.min(metric).alias("minimum"), F.max(metric).alias("maximum"), (F.max(metric) - F.min(metric)).alias("range"))


def run_summary(per_name: DataFrame, expected: int | None = None) -> DataFrame:
    """Per run: mean precision, recall and F1, covered and all authors, micro coverage; runs short of names drop out."""
    s = per_name.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("names"), F.avg("pairwise_precision").alias("average_pairwise_precision"), F.avg("pairwise_recall").alias("average_pairwise_recall"), F.avg("pairwise_f1").alias("average_pairwise_f1"),
        F.sum("fully_covered_authors").alias("fully_covered_authors"), F.sum("total_authors").alias("total_authors"), (F.sum("fully_covered_authors") / F.sum("total_authors")).alias("overall_complete_author_coverage"))
    return s if expected is None else s.where(F.col("names") == expected)


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as z-score with the population's standard deviation; 0 where that is 0 or missing."""
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()  # one row
    z = [F.coalesce((F.col(c) - stats[f"m{i}"]) / stats[f"s{i}"], F.lit(0.0)).alias(c) if stats[f"s{i}"] else F.lit(0.0).alias(c) for i, c in enumerate(columns)]
    return df.select(*[c for c in df.columns if c not in columns], *z)


def ranked(df: DataFrame, metric: str, name: str = "name") -> DataFrame:
    """Add ``rank``: 1 for the least metric (null first), ties by name."""
    return numbered_within(df, [], [metric, name], "rank").withColumn("rank", F.col("rank") + 1)


def zero_as_missing(value: Column) -> Column:
    """The sort value in which null and 0.0 both count as -1."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(-1.0))


def combination_ranking(df: DataFrame, coverage: str, recall: str) -> DataFrame:
    """Combinations by coverage, then recall, greatest first; those without results last. Combinations are few."""
    w = Window.orderBy(F.col(coverage).isNull(), zero_as_missing(F.col(coverage)).desc(), zero_as_missing(F.col(recall)).desc(), "combination")
    return df.withColumn("rank", F.row_number().over(w))


def refinement_ranking(df: DataFrame, completed: str, f1: str, precision: str) -> DataFrame:
    """Refinements by completed blocks, then F1, then precision, greatest first; null counts as least. They are few."""
    low = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).desc()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(low(completed), low(f1), low(precision), "combination")))


def systematic_sample(df: DataFrame, strata: list[str], order: list[str], limit: int) -> DataFrame:
    """Every k-th row of each stratum in the given order, k = ceil(rows / limit), and at most ``limit`` of them.

    (strata, order) must be unique.
    """
    of = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}"))
    marked = numbered_within(df, strata, order, "_r").alias("d").join(of.alias("o"), same).select("d.*", "_n")
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / limit))
    return marked.where((F.col("_r") % step == 0) & (F.col("_r") / step < limit)).drop("_n", "_r")


def sampled_pairs(papers: DataFrame, limit: int) -> DataFrame:
    """(author_block, gt_same, paper_i, paper_j): ``systematic_sample`` of the pairs of a block by equal and by different
    authors, ordered by both ids, without making the pairs. ``papers`` has name, i (from 0), paper_id and author.

    The number of pairs that a paper begins follows from its place in the block and in its author's papers; summed up
    in the order of ids they tell which paper begins the k-th pair. Only those papers, at most ``limit`` in a stratum,
    are then held against the later papers of their block to find the second one.
    """
    p = cut_lineage(papers.select("name", "i", "paper_id", "author"))
    size = p.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    own = p.groupBy("name", "author").agg(F.count(F.lit(1)).alias("m"))
    placed = numbered_within(p, ["name", "author"], ["i"], "k").join(size, "name").join(own, ["name", "author"])
    same = F.col("m") - F.col("k") - 1
    begun = placed.select("name", "i", "paper_id", "author", F.explode(F.array(F.struct(F.lit(True).alias("gt_same"), same.alias("c")), F.struct(F.lit(False).alias("gt_same"), (F.col("n") - F.col("i") - 1 - same).alias("c")))).alias("s"))
    begun = begun.select("name", "i", "paper_id", "author", "s.gt_same", "s.c").where("c > 0")
    summed = weighted_rank(begun, ["name", "gt_same"], "paper_id", "c", "below")
    total = begun.groupBy("name", "gt_same").agg(F.sum("c").alias("of"))
    step = F.greatest(F.lit(1), F.ceil(F.col("of") / limit))
    first, last = F.ceil(F.col("below") / F.col("step")), F.least(F.lit(limit - 1), F.floor((F.col("below") + F.col("c") - 1) / F.col("step")))
    drawn = summed.join(total, ["name", "gt_same"]).withColumn("step", step).where(first <= last)
    drawn = drawn.select("name", "gt_same", "i", "paper_id", "author", F.transform(F.sequence(first, last), lambda x: x * F.col("step") - F.col("below") + 1).alias("wanted"))
    later = p.select("name", F.col("i").alias("j"), F.col("paper_id").alias("paper_j"), F.col("author").alias("author_j"))
    # a block's papers meet at most 2 * limit papers of it
    both = drawn.join(later, "name").where((F.col("j") > F.col("i")) & ((F.col("author") == F.col("author_j")) == F.col("gt_same")))
    w = Window.partitionBy("name", "gt_same", "paper_id").orderBy("paper_j")
    return both.withColumn("r", F.row_number().over(w)).where(F.array_contains("wanted", F.col("r").cast("long"))).select(F.col("name").alias("author_block"), "gt_same", F.col("paper_id").alias("paper_i"), "paper_j")


def best_row(df: DataFrame, by: list[str], metric: str, tie: str, greatest: bool = True) -> DataFrame:
    """The row with the greatest (or least) metric per key; ties go to the least tie-breaker."""
    order = F.col(metric).desc() if greatest else F.col(metric).asc()
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))).where("_r = 1").drop("_r")


def replaced_clusters(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, paper_id): parents without children pass through, the others are replaced by their children."""
    kept = parents.join(children.select(*keys, "parent_index").distinct(), (parents["cluster_index"] == F.col("parent_index")) & reduce(lambda a, b: a & b, [parents[k] == children[k] for k in keys]), "left_anti")
    return kept.select(*keys, F.col("cluster_index").cast("string").alias("cluster"), "paper_id").unionByName(
        children.select(*keys, F.concat_ws(".", F.col("parent_index").cast("string"), F.col("child_index").cast("string")).alias("cluster"), "paper_id"))
