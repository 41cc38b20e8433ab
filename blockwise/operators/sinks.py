"""Writing results: JSON, prompts as text, CSV with fixed columns, annotated results, merged predictions, models, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import cut_lineage


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_prompts(prompts: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One line per prompt (line breaks escaped) in folders by block or condition."""
    df = prompts.select(*(by or []), F.replace(F.replace("prompt", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")).alias("value"))
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns in their order, with a header; nothing is written for an empty frame."""
    df = cut_lineage(df)  # asked for emptiness and then written
    if not df.isEmpty():
        df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def annotated_results(clusters: DataFrame, truth: DataFrame, blocks: DataFrame) -> DataFrame:
    """(name, paper_count, true_author_count, clusters): every cluster with its papers and their true authors.

    Fails at run time for a block whose clustered papers are not exactly those of the block index.
    """
    from blockwise.operators.labels import violations

    v = violations(clusters, blocks, ["name"]).select("name", "status")
    ok = F.when(F.col("status") != "ok", F.raise_error(F.concat_ws(" ", F.lit("result does not fit the block:"), "name", "status")).cast("boolean")).otherwise(F.lit(True))
    rows = clusters.join(truth.select("name", "paper_id", F.col("label").alias("true_author_id")), ["name", "paper_id"], "left")
    per = rows.groupBy("name", "cluster_index").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("pos", "paper_id", "true_author_id"))).alias("papers"))
    whole = per.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("cluster_index", "label", "papers"))).alias("clusters"))
    counts = rows.groupBy("name").agg(F.countDistinct("paper_id").alias("paper_count"), F.countDistinct("true_author_id").alias("true_author_count"))
    return whole.join(counts, "name").join(v, "name").where(ok).select("name", "paper_count", "true_author_count", "clusters")


def merged_predictions(clusters: DataFrame) -> DataFrame:
    """(name, clusters): the nested lists of paper ids that the evaluator reads, one row per block."""
    per = clusters.groupBy("name", "cluster_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paper_id"))), lambda s: s["paper_id"]).alias("ids"))
    return per.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_index", "ids"))), lambda s: s["ids"]).alias("clusters"))


def write_prediction_lines(clusters: DataFrame, path: str) -> None:
    """Merged predictions as JSON lines {"name", "clusters"}."""
    merged_predictions(clusters).write.mode("overwrite").json(path)


def write_model(model: DataFrame, path: str, threshold: float, seed: int, target: str) -> None:
    """A fitted model with all that scoring needs (medians, means, scales, coefficients) and its settings, as Parquet."""
    model.withColumns({"threshold": F.lit(float(threshold)), "seed": F.lit(seed), "target": F.lit(target)}).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(model, settings) as ``write_model`` wrote them."""
    rows = spark.read.parquet(path)
    first = rows.select("threshold", "seed", "target").first()  # the same in every row
    return rows.drop("threshold", "seed", "target"), first.asDict() if first else {}


def markdown_table(df: DataFrame, limit: int | None = None, order: list[str] | None = None) -> str:
    """A report frame as a Markdown table, sorted by ``order`` (all columns); numbers with four digits, null as N/A.

    All rows are written; beyond a ``limit`` a closing line tells how many rows are left out.
    """
    rows, left = [], 0
    for r in df.orderBy(*(order or df.columns)).toLocalIterator():
        if limit is None or len(rows) < limit:
            rows.append(r)
        else:
            left += 1
    text = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in rows)]
    if left:
        lines.append(f"\n{left} further rows are left out.")
    return "\n".join(lines)
