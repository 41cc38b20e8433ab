"""Filters, sweeps, status and orderings over runs and papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.common import numbered_within
from blockwise.functions.fields import organization_tokens
from blockwise.functions.text import whole_year

#: Ends of a response that mean it was finished.
FINISHED = ("stop", "end_turn")
MISSING_ORGANIZATION = "__missing_organization__"


def completed(responses: DataFrame) -> DataFrame:
    """Responses that came to their end and hold content."""
    return responses.where(F.col("finish_reason").isin(*FINISHED) & F.col("content").isNotNull())


def select_names(df: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Rows of the given names; an error names those the frame does not have."""
    known = {r[0] for r in df.where(F.col(column).isin(names)).select(column).distinct().collect()}
    unknown = sorted(set(names) - known)
    if unknown:
        raise ValueError(f"unknown names: {unknown}")
    return df.where(F.col(column).isin(names))


def category_key(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order, from 1; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), value), F.lit(0))


def band(metric: Column, study: str = "context") -> Column:
    """Difficulty: easy from .90, medium from .80, hard below; in the prompt study hard is [.60, .80) and less is null."""
    hard = F.lit("hard") if study == "context" else F.when(metric >= 0.60, "hard")
    return F.when(metric >= 0.90, "easy").when(metric >= 0.80, "medium").when(metric.isNotNull(), hard)


def error_flags(df: DataFrame, metric: str = "b3_f1") -> DataFrame:
    """reliable (from .85), hard (below .80) and catastrophic (below .50) as 0/1."""
    m = F.col(metric)
    return df.select("*", (m >= 0.85).cast("int").alias("reliable_085"), (m < 0.80).cast("int").alias("hard_080"), (m < 0.50).cast("int").alias("catastrophic_050"))


def preferred_pool(df: DataFrame, paper_count: str = "paper_count", limit_org: float = 0.7, limit_coauthor: float = 0.9) -> DataFrame:
    """Blocks with at most the median number of papers and good coverage; the whole pool where there is none.

    The pool is split by ``difficulty``; median and counts are taken within it.
    """
    med = df.groupBy("difficulty").agg(F.percentile(paper_count, F.lit(0.5)).alias("_m"))
    marked = df.join(med, "difficulty").withColumn("_p", (F.col(paper_count) <= F.col("_m")) & (F.col("organization_coverage") >= limit_org) & (F.col("coauthor_coverage") >= limit_coauthor))
    any_ = marked.groupBy("difficulty").agg(F.count_if("_p").alias("_n"))
    return marked.join(any_, "difficulty").where(F.col("_p") | (F.col("_n") == 0)).drop("_m", "_p", "_n")


def seeded_order(seed: int, *columns: str) -> Column:
    """A value to sort by that shuffles rows the same way on every system: a digest of the columns and the seed."""
    return F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def seeded_choice(df: DataFrame, seed: int = 42, first: int = 10) -> DataFrame:
    """One block per difficulty: of the preferred pool (``preferred_pool``) the ``first`` smallest by papers and name, and
    of these the one that a seeded order puts first."""
    from pyspark.sql import Window

    by = Window.partitionBy("difficulty")
    small = preferred_pool(df.where("difficulty is not null")).withColumn("_r", F.row_number().over(by.orderBy("paper_count", "name"))).where(F.col("_r") <= first)
    return small.withColumn("_c", F.row_number().over(by.orderBy(seeded_order(seed, "name"), "name"))).where("_c = 1").drop("_r", "_c")


def mixed_clusters(compositions: DataFrame, keys: list[str], every: bool = False) -> DataFrame:
    """(keys, cluster_index): clusters with several true authors, or with ``every`` those with several papers."""
    g = compositions.groupBy(*keys, "cluster_index").agg(F.countDistinct("author").alias("authors"), F.sum("n").alias("papers"))
    return g.where("papers > 1" if every else "authors > 1").select(*keys, "cluster_index")


def prompt_budget(requests: DataFrame, limits: DataFrame, feasible: int = 18000) -> DataFrame:
    """Requests with their tokens (characters // 4), whether these are within the model's limit, and feasible at all."""
    tokens = F.floor(F.length("prompt") / 4)
    lim = limits.select("model", "prompt_limit")
    return requests.join(lim, "model").select("*", tokens.alias("tokens"), (tokens <= F.col("prompt_limit")).alias("within_limit"), (tokens <= feasible).alias("feasible"))


def hardest(df: DataFrame, metric: str, below: float) -> DataFrame:
    return df.where(F.col(metric) < below).orderBy(metric, "name")


def to_do(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work that has no stored result yet; all of it with ``force``."""
    return wanted if force else wanted.join(done.select(*keys), keys, "left_anti")


def run_status(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, status): completed if any answer was, failed if there are answers only, not_run else."""
    per = responses.groupBy("request_id").agg(F.count("response_id").alias("n"), F.count_if(F.col("finish_reason").isin(*FINISHED) & F.col("content").isNotNull()).alias("good"))
    return wanted.join(per, "request_id", "left").select("request_id", F.when(F.coalesce("n", F.lit(0)) == 0, "not_run").when(F.col("good") > 0, "completed").otherwise("failed").alias("status"))


def sweep(names: DataFrame, **dimensions: list) -> DataFrame:
    """Every name with every combination of the given values; each dimension is a short list, exploded in place."""
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))), dimensions.items(), names)


def same_sets(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys of a, same): whether both sides hold the same set of values under a key."""
    x = a.select(*keys, value).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys, value).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, [*keys, value], "full").groupBy(*keys).agg(F.count("_a").alias("_na"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_d"))
    return both.where("_na > 0").select(*keys, (F.col("_d") == 0).alias("same"))


def chronological(cards: DataFrame) -> DataFrame:
    """Add ``place``: papers of a block by year (missing or no whole number last), then id."""
    keyed = cards.withColumn("_year", F.coalesce(whole_year("year").cast("long"), F.lit(1 << 40)))
    return numbered_within(keyed, ["name"], ["_year", "paper_id"], "place").drop("_year").withColumn("place", F.col("place") + 1)


def organization_groups(cards: DataFrame) -> DataFrame:
    """Add ``org_key`` (sorted distinct tokens, or a mark for none) and ``group_no``: groups of a block in key order."""
    key = F.coalesce(F.nullif(F.array_join(F.array_sort(organization_tokens()), " "), F.lit("")), F.lit(MISSING_ORGANIZATION))
    keyed = cards.withColumn("org_key", key)
    groups = numbered_within(keyed.select("name", "org_key").distinct(), ["name"], ["org_key"], "group_no")
    return keyed.join(groups.withColumn("group_no", F.col("group_no") + 1), ["name", "org_key"])
