"""The project's tables as the frames the operators take: block index, store, truth, cards, responses as clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import read_table
from blockwise.functions.fields import block_papers


def block_index(raw: DataFrame) -> DataFrame:
    """(name, paper_id, record_index): each paper of a block once, at its first place; redelivered rows are dropped."""
    return raw.where("name is not null and paper_id is not null").groupBy("name", "paper_id").agg(F.min("record_index").alias("record_index"))


def latest_papers(pub: DataFrame) -> DataFrame:
    """The store with the newest version per id; equal times go to the greatest content."""
    cols = ["title", "abstract", "keywords", "venue", "year", "authors"]
    row = F.struct("updated_at", *cols)
    return pub.where("id is not null").groupBy("id").agg(F.max(row).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def truth_labels(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, paper_id, label) for papers of the block index; of several known authors the least id is taken."""
    one = labels.where("author_id is not null").groupBy("name", "paper_id").agg(F.min("author_id").alias("label"))
    return one.join(blocks.select("name", "paper_id"), ["name", "paper_id"], "left_semi")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return block_index(read_table(spark, d, "sna_valid_raw"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(read_table(spark, d, "sna_valid_pub"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return truth_labels(read_table(spark, d, "sna_valid_labels"), blocks(spark, d))


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Block index joined with the store, with the fields relative to the block's name."""
    return block_papers(blocks(spark, d), papers(spark, d))


def response_universe(spark: SparkSession, d: str) -> DataFrame:
    """(response_id, name, paper_id): the papers of the slice each response was asked about."""
    req = read_table(spark, d, "cluster_requests").where("task = 'assign' and request_id is not null").select("request_id", "name", "first_index", "paper_count").distinct()
    res = read_table(spark, d, "cluster_responses").where("response_id is not null").select("response_id", "request_id").distinct()
    slots = res.join(req, "request_id").where("paper_count > 0").select("response_id", "name", F.explode(F.sequence("first_index", F.col("first_index") + F.col("paper_count") - 1)).alias("record_index"))
    return slots.join(blocks(spark, d), ["name", "record_index"]).select("response_id", "name", "paper_id")


def response_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(response_id, name, cluster_index, pos, paper_id) from the parsed assignments of the responses.

    Clusters are numbered by their first record; keys that are no record number are dropped; records beyond the block
    get the id "#<record>", which no universe holds.
    """
    req = read_table(spark, d, "cluster_requests").where("task = 'assign' and request_id is not null").select("request_id", "name", "first_index").distinct()
    res = read_table(spark, d, "cluster_responses").where("response_id is not null and assignments is not null").select("response_id", "request_id", F.map_entries("assignments").alias("m")).distinct()
    rows = res.join(req, "request_id").select("response_id", "name", "first_index", F.explode("m").alias("e")).select(
        "response_id", "name", "first_index", F.col("e.key").try_cast("int").alias("k"), F.col("e.value").alias("c")).where("k is not null and k >= 0")
    first = rows.groupBy("response_id", "c").agg(F.min("k").alias("cluster_index"))
    placed = rows.join(first, ["response_id", "c"]).withColumn("record_index", F.col("first_index") + F.col("k"))
    return placed.join(blocks(spark, d), ["name", "record_index"], "left").select(
        "response_id", "name", "cluster_index", F.col("k").alias("pos"), F.coalesce("paper_id", F.concat(F.lit("#"), F.col("record_index").cast("string"))).alias("paper_id"))


def venue_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A clustering of every block by rule, with the defects real ones have: papers of one venue form a cluster; papers
    without a venue are missing, and papers with keywords stand in a second cluster of their year as well."""
    c = cards(spark, d).select("name", "paper_id", "record_index", F.trim(F.coalesce("venue", F.lit(""))).alias("venue"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.trim(F.coalesce("year", F.lit(""))).alias("year"))
    by_venue = c.where("venue != ''").select("name", "paper_id", "record_index", F.concat(F.lit("v:"), "venue").alias("label"))
    by_year = c.where("keywords != '' and year != ''").select("name", "paper_id", "record_index", F.concat(F.lit("y:"), "year").alias("label"))
    rows = by_venue.unionByName(by_year)
    index = rows.groupBy("name", "label").agg(F.min(F.struct("record_index", "label")).alias("m"))
    from pyspark.sql import Window

    # clusters of a block are few against its papers: numbered by their first record
    number = index.select("name", "label", (F.row_number().over(Window.partitionBy("name").orderBy("m")) - 1).alias("cluster_index"))
    return rows.join(number, ["name", "label"]).select("name", "cluster_index", "label", F.col("record_index").alias("pos"), "paper_id")


def venue_labels(spark: SparkSession, d: str) -> DataFrame:
    """(name, paper_id, label) by venue, defined for every paper of the store in a block."""
    return cards(spark, d).select("name", "paper_id", F.coalesce(F.nullif(F.trim("venue"), F.lit("")), F.concat(F.lit("missing:"), "paper_id")).alias("label"))
