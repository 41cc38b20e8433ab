"""Fields of a paper relative to the name of its block, cards and per-paper features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions.text import alnum_key, clean_text, name_forms, tokens

#: The fields a card may hold, in their fixed order.
FIELDS = ["title", "abstract", "keywords", "organization", "coauthors", "venue", "year"]


def with_target_fields(papers: DataFrame, name: str = "name", authors: str = "authors") -> DataFrame:
    """Add ``organization`` (orgs of the authors that bear the block's name) and ``coauthors`` (names of the others).

    A name matches if its letters and digits equal the target's, forwards or with the words reversed. Duplicates and
    empty strings are kept, a null author list gives empty lists, null names and orgs become "". An author whose name
    has no ASCII letter or digit is a coauthor.
    """
    forms = name_forms(name)
    everyone = F.coalesce(F.col(authors), F.array().cast("array<struct<name:string,org:string>>"))
    own = lambda a: F.array_contains(forms, alnum_key(a["name"])) & (alnum_key(a["name"]) != "")
    return papers.withColumn("organization", F.transform(F.filter(everyone, own), lambda a: F.coalesce(a["org"], F.lit("")))).withColumn(
        "coauthors", F.transform(F.filter(everyone, lambda a: ~own(a)), lambda a: F.coalesce(a["name"], F.lit(""))))


def block_papers(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """The equi join of block index and store, with the fields relative to each block's name. Unknown papers drop out."""
    p = papers.withColumnRenamed("id", "paper_id")
    return with_target_fields(blocks.join(p, "paper_id"))


def unknown_papers(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """The guard of the join: block rows whose paper the store does not have."""
    return blocks.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_anti")


def card(fields: list[str], identity: str = "paper_id") -> Column:
    """A card as a struct: the identity, then the named fields in the given order."""
    return F.struct(F.col(identity), *[F.col(f) for f in fields])


def display_id(index: Column) -> Column:
    return F.concat(F.lit("P"), (index + 1).cast("string"))


def indexed_cards(cards: DataFrame, fields: list[str]) -> DataFrame:
    """(name, record_index, display_id, card): papers named by their place in the block, from 0 without gaps."""
    from blockwise.common import numbered_within

    p = numbered_within(cards.select("name", "paper_id", "record_index", *fields), ["name"], ["record_index", "paper_id"], "_place").withColumn("record_index", F.col("_place"))
    return p.select("name", "paper_id", "record_index", display_id(F.col("record_index")).alias("display_id"), F.struct(F.col("record_index"), *fields).alias("card"))


def coauthor_set(coauthors: str = "coauthors", name: str = "name") -> Column:
    """Distinct cleaned coauthor names that are neither empty nor the target."""
    target = clean_text(name)
    return F.array_distinct(F.filter(F.transform(coauthors, lambda x: clean_text(x)), lambda x: (x != "") & (x != target)))


def alnum_coauthor_set(coauthors: str = "coauthors") -> Column:
    return F.array_distinct(F.filter(F.transform(coauthors, lambda x: alnum_key(x)), lambda x: x != ""))


def organization_tokens(organization: str = "organization") -> Column:
    """Distinct tokens of all organizations of the target in a paper."""
    return F.array_distinct(tokens(F.array_join(organization, " ")))


def target_org(organization: str = "organization") -> Column:
    """The first organization of the target, cleaned; "" where there is none."""
    return clean_text(F.get(organization, F.lit(0)))


def paper_features(cards: DataFrame) -> DataFrame:
    """One row per (block, paper): text for vectors (abstract cut at 1200) and display (350), sets and availability."""
    abstract = F.coalesce("abstract", F.lit(""))
    return cards.select(
        "name", "paper_id", "record_index", clean_text("title").alias("title_clean"), F.substring(abstract, 1, 1200).alias("abstract_vector"), F.substring(abstract, 1, 350).alias("abstract_display"),
        target_org().alias("org"), coauthor_set().alias("coauthor_set"), (clean_text("title") != "").alias("title_available"), (clean_text("abstract") != "").alias("abstract_available"),
        (target_org() != "").alias("organization_available"), (F.size(coauthor_set()) > 0).alias("coauthor_available"))


def coverage(cards: DataFrame, blocks: DataFrame, policy: str = "mart") -> DataFrame:
    """Share of a block's papers with title, organization and coauthors, and the mean of the three.

    policy "mart": title not empty, any organization not empty, any coauthor; "router": non-empty token set, cleaned
    set and cleaned title; "dry_run": truthiness of the list itself, so that [""] counts. The denominator is the
    number of papers in the block index, so papers absent from the store count as uncovered.
    """
    if policy == "mart":
        has = (F.coalesce(F.length("title"), F.lit(0)) > 0, F.exists("organization", lambda x: x != ""), F.size("coauthors") > 0)
    elif policy == "router":
        has = (clean_text("title") != "", F.size(organization_tokens()) > 0, F.size(coauthor_set()) > 0)
    elif policy == "dry_run":
        has = (F.coalesce(F.length("title"), F.lit(0)) > 0, F.size("organization") > 0, F.size("coauthors") > 0)
    else:
        raise ValueError(f"unknown policy {policy}")
    size = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("paper_count"))
    got = cards.groupBy("name").agg(*[F.sum(h.cast("int")).alias(n) for h, n in zip(has, ("t", "o", "c"))])
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("paper_count")
    return size.join(got, "name", "left").select("name", "paper_count", share("t").alias("title_coverage"), share("o").alias("organization_coverage"), share("c").alias("coauthor_coverage"), ((share("t") + share("o") + share("c")) / 3).alias("overall_coverage"))


def parse_combination(text: str) -> list[str]:
    """The fields of "a+b", checked: known, no repetition."""
    parts = [p.strip() for p in text.split("+")]
    unknown = [p for p in parts if p not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    if len(set(parts)) != len(parts):
        raise ValueError(f"repeated fields: {text}")
    return parts


def field_combinations(spark: SparkSession, size: int, requested: list[str] | None = None) -> DataFrame:
    """(combination, n_fields): all combinations of ``size`` fields, or the requested ones of that size."""
    if not 1 <= size <= len(FIELDS):
        raise ValueError("size out of range")
    chosen = [parse_combination(r) for r in requested] if requested else [list(c) for c in combinations(FIELDS, size)]
    wrong = [c for c in chosen if len(c) != size]
    if wrong:
        raise ValueError(f"combinations of another size: {wrong}")
    return spark.createDataFrame([("+".join(c), len(c)) for c in chosen], "combination string, n_fields int")
