"""Files of the interchange formats: JSON documents keyed by name, JSON lines, CSV with a fixed schema, result folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTHORS = "array<struct<name:string,org:string>>"
PAPER = f"struct<id:string,title:string,abstract:string,keywords:string,venue:string,year:string,authors:{AUTHORS}>"


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value): a JSON document that is one map. The schema of the values is given, never inferred.

    A document is one line of input by nature; the maps of many files are read side by side. A document that is not
    JSON of that shape fails at run time.
    """
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", f"map<string,{schema}>").alias("m"), "value")
    checked = m.select(F.when(F.col("m").isNull(), F.raise_error(F.lit(f"not a JSON map of the expected shape: {path}"))).otherwise(F.col("m")).alias("m"))
    return checked.select(F.explode("m").alias("key", "value"))


def read_block_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, record_index, paper_id) from {name: [paper ids]}; the order of the list is the record index."""
    return read_document(spark, path, "array<string>").select(F.col("key").alias("name"), F.posexplode("value").alias("record_index", "paper_id"))


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """The store from {paper id: paper}; the key is the id. Absent fields are null."""
    p = read_document(spark, path, PAPER)
    return p.select(F.col("key").alias("id"), *[F.col(f"value.{c}").alias(c) for c in ("title", "abstract", "keywords", "venue", "year", "authors")])


def truth_path(folder: str, explicit: str | None = None) -> str:
    """The explicit truth file, else the folder's *_ground_truth.json, else its *_example.json."""
    if explicit:
        return explicit
    names = sorted(os.listdir(folder))
    for end in ("_ground_truth.json", "_example.json"):
        for n in names:
            if n.endswith(end):
                return os.path.join(folder, n)
    raise FileNotFoundError(f"no truth file in {folder}")


def read_truth(spark: SparkSession, path: str, shape: str = "map") -> DataFrame:
    """(name, author_id, paper_id) from {name: {author: [ids]}} ("map") or {name: [[ids]]} ("list", ids are positions).

    "auto" tells the two apart name by name; a value that is neither fails at run time.
    """
    as_map, as_list = "map<string,array<string>>", "array<array<string>>"
    if shape == "map":
        t = read_document(spark, path, as_map).select(F.col("key").alias("name"), F.explode("value").alias("author_id", "ids"))
    elif shape == "list":
        t = read_document(spark, path, as_list).select(F.col("key").alias("name"), F.posexplode("value").alias("a", "ids")).select("name", F.col("a").cast("string").alias("author_id"), "ids")
    elif shape == "auto":
        raw = read_document(spark, path, "string").select(F.col("key").alias("name"), F.from_json("value", as_map).alias("m"), F.from_json("value", as_list).alias("l"), F.col("value").alias("v"))
        usable = (F.startswith("v", F.lit("{")) & F.col("m").isNotNull()) | (F.startswith("v", F.lit("[")) & F.col("l").isNotNull())
        named = F.map_from_entries(F.transform("l", lambda ids, k: F.struct(k.cast("string"), ids)))
        groups = F.when(~F.coalesce(usable, F.lit(False)), F.raise_error(F.concat(F.lit("truth must map authors to papers or list clusters: "), "name"))).when(F.startswith("v", F.lit("{")), F.col("m")).otherwise(named)
        t = raw.select("name", F.explode(groups).alias("author_id", "ids"))
    else:
        raise ValueError(f"unknown shape {shape}")
    return t.select("name", "author_id", F.explode("ids").alias("paper_id"))


def read_predictions(spark: SparkSession, path: str, shape: str = "nested") -> DataFrame:
    """(name, cluster_index, pos, paper_id) from {name: [[ids]]} ("nested") or {name_k: [ids]} ("flat")."""
    if shape == "nested":
        p = read_document(spark, path, "array<array<string>>").select(F.col("key").alias("name"), F.posexplode("value").alias("cluster_index", "ids"))
    elif shape == "flat":
        p = read_document(spark, path, "array<string>").select(F.regexp_replace("key", r"_\d+$", "").alias("name"), F.regexp_extract("key", r"_(\d+)$", 1).try_cast("int").alias("cluster_index"), F.col("value").alias("ids"))
    else:
        raise ValueError(f"unknown shape {shape}")
    return p.select("name", "cluster_index", F.posexplode("ids").alias("pos", "paper_id"))


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, cluster_index, pos, paper_id) from JSON lines {"name", "clusters"}; the last record of a name wins.

    Lines are read as rows, so that a large file is split over tasks. Order is that of the paths, then of the lines:
    Spark gives rows of a split ascending ids, and splits of a file are told apart by where they begin. Blank lines
    are skipped. A line that is not JSON or lacks a key fails at run time with the line itself and its file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"), F.col("value").alias("line")).where("trim(line) <> ''")
    rec = raw.select("file", "start", "no", "line", F.from_json("line", "struct<name:string,clusters:array<array<string>>>").alias("r"))
    bad = F.col("r").isNull() | F.col("r.name").isNull() | F.col("r.clusters").isNull()
    message = F.concat(F.lit("bad record in "), "file", F.lit(": "), F.substring("line", 1, 200))
    rec = rec.select(F.struct("file", "start", "no").alias("at"), F.when(bad, F.raise_error(message)).otherwise(F.col("r")).alias("r"))
    last = rec.groupBy(F.col("r.name").alias("name")).agg(F.max_by("r", "at").alias("r"))
    return last.select("name", F.posexplode("r.clusters").alias("cluster_index", "ids")).select("name", "cluster_index", F.posexplode("ids").alias("pos", "paper_id"))


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header and a given schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All result files under a folder (JSON, one object each) with the path they came from."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def latest_files(spark: SparkSession, path: str, key_pattern: str) -> DataFrame:
    """(key, path, modified): the newest file per key, which a regular expression takes from the path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    f = f.withColumn("key", F.regexp_extract("path", key_pattern, 1)).where("key <> ''")
    return f.groupBy("key").agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("key", F.col("m.path").alias("path"), F.col("m.modificationTime").alias("modified"))


def result_folder(combination: list[str]) -> str:
    """Where the results of a field combination lie: single_field/<field> or <k>_fields/<a+b>."""
    return f"single_field/{combination[0]}" if len(combination) == 1 else f"{len(combination)}_fields/{'+'.join(combination)}"


def truth_from_annotated(annotated: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, author_id, paper_id) rebuilt from annotated results with clusters[].papers[].

    Fails at run time for a block whose annotated papers are not exactly those of the block index.
    """
    rows = annotated.select("name", F.explode("clusters").alias("c")).select("name", F.explode("c.papers").alias("p")).select("name", F.col("p.paper_id").alias("paper_id"), F.col("p.true_author_id").alias("author_id")).distinct()
    names = rows.select("name").distinct()
    both = rows.select("name", "paper_id").distinct().withColumn("_a", F.lit(1)).join(blocks.join(names, "name", "left_semi").select("name", "paper_id").withColumn("_b", F.lit(1)), ["name", "paper_id"], "full")
    gaps = both.groupBy("name").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("gaps"))
    ok = F.when(F.col("gaps") > 0, F.raise_error(F.concat(F.lit("annotated papers differ from the block: "), F.col("name"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(gaps, "name").where(ok).select("name", "author_id", "paper_id")
