"""Reading the answers of an external clustering service: parsing, envelope checks, recovery, usage and failures."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$")
_S = T.StringType()
ROWS = T.ArrayType(T.StructType([T.StructField("key", _S), T.StructField("cluster", _S)]))
PARSED = T.StructType([T.StructField("status", _S), T.StructField("kind", _S), T.StructField("assignments", ROWS), T.StructField("labels", T.MapType(_S, _S))])


def parse_json_text(content: str | None):
    """The JSON value of an answer: fences off, and on failure the part from the first "{" to the last "}".

    Raises ValueError("empty") for an empty answer and ValueError("invalid") where neither is JSON.
    """
    text = _FENCE.sub("", (content or "").strip())
    if not text:
        raise ValueError("empty")
    lo, hi = text.find("{"), text.rfind("}")
    for part in (text, text[lo : hi + 1] if 0 <= lo < hi else None):
        if part is not None:
            try:
                return json.loads(part)
            except (ValueError, RecursionError):
                pass
    raise ValueError("invalid")


def _plain(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def parse_one(content: str | None) -> dict:
    try:
        value = parse_json_text(content)
    except ValueError as e:
        return {"status": str(e), "kind": None, "assignments": None, "labels": None}
    if isinstance(value, dict) and isinstance(value.get("clusters"), list):
        rows = [{"key": str(p), "cluster": str(i)} for i, c in enumerate(value["clusters"]) for p in (c.get("paper_ids", []) if isinstance(c, dict) else c if isinstance(c, list) else [])]
        names = {str(i): _plain(c.get("label", f"cluster {i}")) if isinstance(c, dict) else f"cluster {i}" for i, c in enumerate(value["clusters"])}
        return {"status": "ok", "kind": "clusters", "assignments": rows, "labels": names}
    if isinstance(value, dict) and isinstance(value.get("assignments"), dict):
        labels = value.get("labels")
        return {"status": "ok", "kind": "assignments", "assignments": [{"key": k, "cluster": _plain(v)} for k, v in value["assignments"].items()], "labels": {k: _plain(v) for k, v in labels.items()} if isinstance(labels, dict) else {}}
    return {"status": "no clusters", "kind": None, "assignments": None, "labels": None}


@F.pandas_udf(PARSED)
def parsed(content: pd.Series) -> pd.DataFrame:
    rows = [parse_one(c if isinstance(c, str) else None) for c in content]
    return pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in ("status", "kind", "assignments", "labels")})


def envelope_error(content: Column, finish_reason: Column) -> Column:
    """What is wrong with an answer before it is parsed, null if nothing: no content, or cut at the token limit."""
    empty = F.coalesce(F.regexp_like(content, F.lit(r"(?U)^\s*$")), F.lit(True))
    cut = F.coalesce(finish_reason.isin("length", "max_tokens"), F.lit(False))
    return F.when(empty & cut, "thinking consumed the output budget").when(empty, "empty final content").when(cut, "token limit reached before the JSON was complete")


def whole_envelope_error(error: Column, choices: Column, content: Column, finish_reason: Column, reasoning: Column) -> Column:
    """``envelope_error`` of a whole envelope: first an error object, then missing choices, then the content; an empty
    answer is put down to thinking only if it was cut and holds reasoning."""
    empty = F.coalesce(F.regexp_like(content, F.lit(r"(?U)^\s*$")), F.lit(True))
    cut = F.coalesce(finish_reason.isin("length", "max_tokens"), F.lit(False))
    thought = F.coalesce(F.length(reasoning) > 0, F.lit(False))
    return (
        F.when(error.isNotNull(), F.concat(F.lit("API error: "), error)).when(F.coalesce(choices, F.lit(0)) == 0, "response contains no choices")
        .when(empty & cut & thought, "thinking consumed the output budget").when(empty, "empty final content").when(cut, "token limit reached before the JSON was complete"))


def stale_failures(failed: DataFrame, finished: DataFrame) -> DataFrame:
    """(request_id, response_id) of stored failures whose request has been answered since: what a store may delete."""
    return failed.join(finished.select("request_id").distinct(), "request_id", "left_semi").select("request_id", "response_id")


def clusters_of_answers(answers: DataFrame, strict: bool = True) -> DataFrame:
    """(response_id, cluster_index, label, pos, record_index) of answers that hold assignments.

    Clusters come in the order of their first record; a cluster without a label is "cluster <id>". A key that is no
    whole number, and with ``strict`` a negative one, makes pos count but gives a null record_index.
    """
    p = answers.select("response_id", parsed("content").alias("p")).where("p.status = 'ok' and p.kind = 'assignments'")
    rows = p.select("response_id", "p.labels", F.posexplode("p.assignments").alias("pos", "a")).select("response_id", "labels", "pos", F.trim("a.key").try_cast("int").alias("k"), F.col("a.cluster").alias("c"))
    first = rows.groupBy("response_id", "c").agg(F.min("pos").alias("cluster_index"))
    k = F.when(F.col("k") >= 0, F.col("k")) if strict else F.col("k")
    return rows.join(first, ["response_id", "c"]).select("response_id", "cluster_index", F.coalesce(F.try_element_at("labels", "c"), F.concat(F.lit("cluster "), "c")).alias("label"), "pos", k.alias("record_index"))


def display_to_paper(clusters: DataFrame, display: DataFrame) -> DataFrame:
    """Display ids replaced by paper ids; unknown ids pass through. Both frames are keyed by name and display_id."""
    d = display.select("name", "display_id", F.col("paper_id").alias("_p"))
    return clusters.join(d, ["name", "display_id"], "left").withColumn("paper_id", F.coalesce("_p", "display_id")).drop("_p")


def recover_one(content: str | None) -> list[dict] | None:
    """The object behind "assignments": even if the answer is cut after it; null if it is not whole."""
    content = content or ""
    at = content.find('"assignments"')
    colon = content.find(":", at + 13) if at >= 0 else -1
    if colon < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(content[colon + 1 :].lstrip())
    except (ValueError, RecursionError):
        return None
    return [{"key": k, "cluster": _plain(v)} for k, v in value.items()] if isinstance(value, dict) else None


@F.pandas_udf(ROWS)
def recovered(content: pd.Series) -> pd.Series:
    return pd.Series([recover_one(c if isinstance(c, str) else None) for c in content], dtype=object)


def recover_truncated(answers: DataFrame) -> DataFrame:
    """(response_id, n_assigned, complete): answers whose assignments could be read, and whether their keys are exactly
    0 .. paper_count - 1. ``answers`` has response_id, content and paper_count."""
    r = answers.select("response_id", "paper_count", recovered("content").alias("a")).where("a is not null")
    keys = F.array_sort(F.array_distinct(F.transform("a", lambda x: x["key"].try_cast("int"))))
    want = F.when(F.col("paper_count") > 0, F.sequence(F.lit(0), F.col("paper_count") - 1)).otherwise(F.array().cast("array<int>"))
    return r.select("response_id", F.size("a").alias("n_assigned"), (keys == want).alias("complete"))


def usage(stated: Column, text: Column) -> Column:
    """Stated tokens, or characters // 4 where they are missing or 0."""
    return F.coalesce(F.nullif(stated, F.lit(0)), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def failure_kind(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, failure) of requests without a finished answer: length if any was cut, other, or not_run."""
    per = responses.groupBy("request_id").agg(
        F.count("response_id").alias("n"), F.count_if(F.col("finish_reason").isin("stop", "end_turn") & F.col("content").isNotNull()).alias("good"), F.count_if(F.col("finish_reason").isin("length", "max_tokens")).alias("cut"))
    j = requests.select("request_id").distinct().join(per, "request_id", "left").where("coalesce(good, 0) = 0")
    return j.select("request_id", F.when(F.coalesce("n", F.lit(0)) == 0, "not_run").when(F.col("cut") > 0, "length").otherwise("other").alias("failure"))


def latest_failed(responses: DataFrame) -> DataFrame:
    """The newest unfinished answer per request, by time of receipt and then id."""
    bad = responses.where(~F.coalesce(F.col("finish_reason").isin("stop", "end_turn"), F.lit(False)))
    return bad.groupBy("request_id").agg(F.max(F.struct("received_at", "response_id")).alias("m")).select("request_id", F.col("m.response_id").alias("response_id"))
