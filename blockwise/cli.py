"""Commands: files in, files or a printed report out. Each is a thin shell around the operators.

blockwise-evaluate scores a prediction file, blockwise-cluster runs or checks one block, blockwise-sweep runs every
block with every single field or combination, blockwise-router fits the reliability model. A data folder holds
sna_valid_raw.json, sna_valid_pub.json and a truth file; ``--prefix`` names another beginning than sna_valid.
"""

from __future__ import annotations

import argparse
import json
import os
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import cut_lineage
from blockwise.functions.fields import FIELDS, block_papers
from blockwise.operators import labels as lb
from blockwise.operators import metrics as mt
from blockwise.operators import prompts as pm
from blockwise.operators import responses as rs
from blockwise.operators import router as rt
from blockwise.operators import selection as sl
from blockwise.operators import sinks
from blockwise.operators import similarity as sm
from blockwise.sources import files, service


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("blockwise").getOrCreate()


def load(spark: SparkSession, folder: str, prefix: str = "sna_valid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, cards, truth labels) of a data folder."""
    blocks = cut_lineage(files.read_block_index(spark, os.path.join(folder, f"{prefix}_raw.json")))
    papers = files.read_publications(spark, os.path.join(folder, f"{prefix}_pub.json"))
    truth = files.read_truth(spark, files.truth_path(folder), "auto").groupBy("name", "paper_id").agg(F.min("author_id").alias("label"))
    return blocks, block_papers(blocks, papers), cut_lineage(truth)


def read_prediction(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return files.read_prediction_lines(spark, path) if shape == "lines" else files.read_predictions(spark, path, shape)


def evaluate(spark: SparkSession, data: str, prediction: str, shape: str = "nested", partial: bool = False, prefix: str = "sna_valid") -> tuple[DataFrame, dict]:
    """(scores per block, totals). With ``partial`` only blocks all of whose true papers are predicted count."""
    blocks, _, truth = load(spark, data, prefix)
    clusters = cut_lineage(read_prediction(spark, prediction, shape))
    if partial:
        per, counts = mt.partial_evaluation(truth, lb.assigned_label(clusters, ["name"]), ["name"])
        per = cut_lineage(per)
        return per, {**mt.macro_average(per).first().asDict(), **counts.first().asDict()}  # one row each
    per = cut_lineage(mt.scores(truth, lb.normalized_groups(clusters, blocks, ["name"]), ["name"]))
    return per, mt.macro_average(per).first().asDict()


def cluster(spark: SparkSession, data: str, name: str, response: str | None = None, instruction: str = "minimal", prefix: str = "sna_valid") -> dict:
    """The report of one block: dry-run figures without a response, else the checked and scored answer in the file.

    The answer is the text of the service; it is read, checked against the block and scored. An answer that does not
    fit the block raises ValueError with the reason.
    """
    blocks, cards, truth = load(spark, data, prefix)
    sl.select_names(blocks, [name])
    blocks, cards, truth = (cut_lineage(df.where(F.col("name") == name)) for df in (blocks, cards, truth))
    figures = pm.dry_run(cards, truth).first().asDict()
    figures["prompt_tokens"] = pm.block_prompts(cards, instruction).select(F.floor(F.length("prompt") / 4)).first()[0]
    if response is None:
        return figures
    answer = spark.read.text(response, wholetext=True).select(F.lit(0).cast("long").alias("response_id"), F.col("value").alias("content"))
    error = answer.select(rs.parsed("content").getField("status")).first()[0]
    if error != "ok":
        raise ValueError(error)
    papers = sm.numbered(cards).select(F.col("i").alias("record_index"), "paper_id")
    found = rs.clusters_of_answers(answer).join(papers, "record_index", "left")
    clusters = cut_lineage(found.select(F.lit(name).alias("name"), "cluster_index", "label", "pos", F.coalesce("paper_id", F.concat(F.lit("#"), F.col("record_index").cast("string"))).alias("paper_id")))
    status = lb.violations(clusters, blocks, ["name"]).first()
    if status is None or status["status"] != "ok":
        raise ValueError("the answer does not fit the block: " + ("empty" if status is None else status["status"]))
    report = mt.scores(truth, lb.normalized_groups(clusters, blocks, ["name"]), ["name"]).first()
    return {**figures, **(report.asDict() if report else {}), **mt.coarse_report(truth, clusters, ["name"]).first().asDict()}


def sweep(spark: SparkSession, data: str, size: int = 1, prefix: str = "sna_valid") -> DataFrame:
    """(name, field_combination, requests to send): every block with every combination of ``size`` fields, and the tokens
    of its records with those fields."""
    _, cards, _ = load(spark, data, prefix)
    cards = cut_lineage(cards)
    combos = ["+".join(c) for c in combinations(FIELDS, size)]
    shown = lambda c: F.to_json(F.struct(*[F.col(f) for f in c.split("+")]))
    parts = [cards.select("name", F.lit(c).alias("field_combination"), F.length(shown(c)).alias("n")) for c in combos]
    return reduce(DataFrame.unionByName, parts).groupBy("name", "field_combination").agg(F.count(F.lit(1)).alias("papers"), F.floor(F.sum("n") / 4).alias("record_tokens"))


def router(spark: SparkSession, data: str, prediction: str, model: str, shape: str = "nested", prefix: str = "sna_valid") -> DataFrame:
    """(name, b3_f1, predicted_probability, accepted) of the held-out blocks; the model is written to ``model``."""
    blocks, cards, truth = load(spark, data, prefix)
    cards = cut_lineage(cards)
    clusters = read_prediction(spark, prediction, shape)
    scores = sl.error_flags(mt.scores(truth, lb.normalized_groups(clusters, blocks, ["name"]), ["name"]).select("name", "b3_f1"))
    df = cut_lineage(rt.split_blocks(rt.block_features(cards, blocks).join(scores, "name")))
    fitted, threshold = rt.final_model(df.where("part = 'train'"))
    sinks.write_model(fitted, model, threshold, 42, "reliable_085")
    return rt.predict(fitted, df.where("part = 'test'")).select("name", "b3_f1", "predicted_probability", (F.col("predicted_probability") >= threshold).alias("accepted"))


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def _arguments(text: str, *more: tuple) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=text)
    p.add_argument("--data", required=True)
    p.add_argument("--prefix", default="sna_valid")
    for names, options in more:
        p.add_argument(*names, **options)
    return p.parse_args()


_PREDICTION = (("--prediction",), {"required": True})
_SHAPE = (("--shape",), {"choices": ["nested", "flat", "lines"], "default": "nested"})
_OUTPUT = (("--output",), {})


def evaluate_main() -> None:
    a = _arguments("Score a prediction file.", _PREDICTION, _SHAPE, (("--partial",), {"action": "store_true"}), _OUTPUT)
    per, totals = evaluate(_session(), a.data, a.prediction, a.shape, a.partial, a.prefix)
    if a.output:
        sinks.write_csv(per, a.output, per.columns)
    _show(totals)


def cluster_main() -> None:
    a = _arguments("Show or judge the answer to one block.", (("--name",), {"required": True}), (("--response",), {}), (("--instruction",), {"choices": list(pm.INSTRUCTIONS), "default": "minimal"}), (("--requests",), {}))
    if a.requests:
        _, cards, _ = load(_session(), a.data, a.prefix)
        sinks.write_prompts(pm.block_prompts(cards.where(F.col("name") == a.name), a.instruction), a.requests)
    _show(cluster(_session(), a.data, a.name, a.response, a.instruction, a.prefix))


def sweep_main() -> None:
    a = _arguments("List the requests of a sweep over fields.", (("--size",), {"type": int, "default": 1}), _OUTPUT)
    rows = sweep(_session(), a.data, a.size, a.prefix)
    if a.output:
        sinks.write_csv(rows, a.output, rows.columns)
    else:
        print(sinks.markdown_table(rows))


def router_main() -> None:
    a = _arguments("Fit the reliability model and judge the held-out blocks.", _PREDICTION, _SHAPE, (("--model",), {"required": True}))
    print(sinks.markdown_table(router(_session(), a.data, a.prediction, a.model, a.shape, a.prefix)))
