"""Cluster labels of papers, and checks of a clustering against its block.

A clustering is a frame (keys..., cluster_index, label, pos, paper_id); ``keys`` name one clustering, usually the run
and the block. A universe is a frame (keys..., paper_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assigned_label(clusters: DataFrame, keys: list[str], policy: str = "first") -> DataFrame:
    """(keys, paper_id, label): one cluster per paper; of several the first or the last wins, as ``policy`` says."""
    place = F.struct(F.col("cluster_index"), F.col("pos"))
    pick = F.min if policy == "first" else F.max
    return clusters.groupBy(*keys, "paper_id").agg(pick(F.struct(place.alias("at"), F.col("cluster_index").cast("string").alias("label"))).alias("m")).select(*keys, "paper_id", F.col("m.label").alias("label"))


def complete_labels(universe: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of exactly the papers of the universe; a paper without one becomes a cluster of its own.

    The label of such a paper is made of its id and cannot meet an existing one, unlike a running number would.
    """
    return universe.select(*keys, "paper_id").distinct().join(labels, [*keys, "paper_id"], "left").select(*keys, "paper_id", F.coalesce("label", F.concat(F.lit("missing:"), "paper_id")).alias("label"))


def numbered_singletons(universe: DataFrame, labels: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Like ``complete_labels``, but missing papers are numbered on from the number of labels in use, as one evaluator
    does. Where labels are not 0, 1, .. without gaps (an empty cluster, or one whose papers all went to a later one) a
    number can meet a real cluster, whose papers the missing one then joins."""
    from blockwise.common import numbered_within

    used = labels.groupBy(*keys).agg(F.countDistinct("label").alias("_n"))
    rows = universe.select(*keys, "paper_id", *[c for c in order if c != "paper_id"]).distinct()
    lost = numbered_within(rows.join(labels, [*keys, "paper_id"], "left_anti"), keys, order, "_k").join(used, keys, "left")
    lost = lost.select(*keys, "paper_id", (F.coalesce("_n", F.lit(0)) + F.col("_k")).cast("string").alias("label"))
    kept = labels.join(rows.select(*keys, "paper_id").distinct(), [*keys, "paper_id"], "left_semi").select(*keys, "paper_id", "label")
    return kept.unionByName(lost)


def normalized_groups(clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, paper_id, label): first cluster wins, unknown papers dropped, missing ones as singletons."""
    return complete_labels(universe, assigned_label(clusters, keys), keys)


def distinct_in_cluster(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Repetitions inside a cluster removed, the first place kept."""
    return clusters.groupBy(*keys, "cluster_index", "paper_id").agg(F.min("pos").alias("pos"))


def flat_prediction_name(name: Column) -> Column:
    """The block of a prediction keyed "<name>_<number>"."""
    return F.regexp_replace(name, r"_\d+$", "")


def violations(clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """One row per clustering or universe: counts of what is wrong, the first five missing ids and a status.

    n_clusters, n_unknown (ids outside the universe), n_repeated (ids in several clusters), n_duplicate (rows beyond
    the first of an id), n_missing. status names the first failed rule: empty, unknown, repeated, missing or ok.
    """
    uni = universe.select(*keys, "paper_id").distinct().withColumn("expected", F.lit(1))
    per_paper = clusters.groupBy(*keys, "paper_id").agg(F.countDistinct("cluster_index").alias("clusters"), F.count(F.lit(1)).alias("rows"))
    both = uni.join(per_paper, [*keys, "paper_id"], "full")
    sizes = clusters.groupBy(*keys).agg(F.countDistinct("cluster_index").alias("n_clusters"))
    missing = F.col("expected").isNotNull() & F.col("rows").isNull()
    agg = both.groupBy(*keys).agg(
        F.count_if(F.col("expected").isNull()).alias("n_unknown"), F.count_if(F.col("clusters") > 1).alias("n_repeated"),
        F.sum(F.coalesce(F.col("rows") - 1, F.lit(0))).alias("n_duplicate"), F.count_if(missing).alias("n_missing"))
    ranked = both.where(missing).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("paper_id"))).where("r <= 5")
    first = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("paper_id")), ",").alias("first_missing"))
    status = (
        F.when(F.coalesce("n_clusters", F.lit(0)) == 0, "empty").when(F.col("n_unknown") > 0, "unknown").when(F.col("n_repeated") > 0, "repeated")
        .when(F.col("n_missing") > 0, "missing").otherwise("ok"))
    return agg.join(sizes, keys, "left").join(first, keys, "left").select(*keys, F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "n_unknown", "n_repeated", "n_duplicate", "n_missing", F.coalesce("first_missing", F.lit("")).alias("first_missing"), status.alias("status"))


def count_check(clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """The variant by counts: duplicate before unknown before missing; see ``violations`` for the counts."""
    v = violations(clusters, universe, keys)
    status = F.when(F.col("n_duplicate") > 0, "duplicate").when(F.col("n_unknown") > 0, "unknown").when(F.col("n_missing") > 0, "missing").otherwise("ok")
    return v.select(*keys, status.alias("status"))


def ordered_check(clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """The variant that reports an empty clustering last: unknown, repeated, missing, empty."""
    v = violations(clusters, universe, keys)
    status = F.when(F.col("n_unknown") > 0, "unknown").when(F.col("n_repeated") > 0, "repeated").when(F.col("n_missing") > 0, "missing").when(F.col("n_clusters") == 0, "empty").otherwise("ok")
    return v.select(*keys, status.alias("status"))


def is_complete(clusters: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, complete): whether the set of returned ids equals the set of expected ids."""
    v = violations(clusters, universe, keys)
    return v.select(*keys, ((F.col("n_unknown") == 0) & (F.col("n_missing") == 0)).alias("complete"))


def require_count(df: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    """The frame, after a check of its number of rows."""
    n = df.count()
    if n != expected:
        raise ValueError(f"expected {expected} {what}, found {n}")
    return df


def require_one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two frames each of which has every key at most once; else an error at run time."""
    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        message = F.concat(F.lit(f"{side} side has a key more than once: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_n")

    return checked(a, "left").join(checked(b, "right"), keys)


def same_information(contexts: DataFrame, columns: list[str]) -> DataFrame:
    """(name, condition, records, same): the records that each condition of a block shows, and whether they are those of
    all its conditions with the same fields.

    ``contexts`` has name, condition, record_index and the columns; records are compared as hashes of their content.
    """
    content = contexts.select("name", "condition", "record_index", F.xxhash64("record_index", *columns).alias("h")).distinct()
    per = content.groupBy("name", "condition").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    every = per.groupBy("name").agg(F.min("records").alias("n"), F.max("records").alias("m"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    return per.join(every, "name").select("name", "condition", "records", ((F.col("n") == F.col("m")) & (F.col("lo") == F.col("hi"))).alias("same"))


def context_of(prompt: Column, instruction: Column, contract: Column) -> Column:
    """What stands between instruction and contract of a prompt; null if either is not in it."""
    end = F.length
    at = F.instr(prompt, instruction)
    tail = F.substring(prompt, at + end(instruction), end(prompt))
    stop = F.instr(tail, contract)
    return F.when((at > 0) & (stop > 0), F.substring(tail, F.lit(1), stop - 1))


def prompt_variants(variants: DataFrame) -> DataFrame:
    """(name, variants, contexts, context_md5): prompts of one block by (name, instruction, contract, prompt).

    Only the instruction may differ: contexts is the number of different texts between instruction and contract (1 if
    all is well; a prompt without its instruction or contract counts as one of its own), context_md5 the least digest.
    """
    c = F.coalesce(context_of(F.col("prompt"), F.col("instruction"), F.col("contract")), F.concat(F.lit("?"), "instruction"))
    return variants.select("name", "instruction", F.md5(c).alias("h")).groupBy("name").agg(F.countDistinct("instruction").alias("variants"), F.countDistinct("h").alias("contexts"), F.min("h").alias("context_md5"))


