"""Queries of runs, conditions, rankings, responses, contexts, prompts and the reliability router."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, read_table, release
from blockwise.functions import fields as fl
from blockwise.operators import analysis as an
from blockwise.operators import labels as lb
from blockwise.operators import metrics as mt
from blockwise.operators import prompts as pm
from blockwise.operators import responses as rs
from blockwise.operators import router as rt
from blockwise.operators import selection as sl
from blockwise.operators import similarity as sm
from blockwise.plans.q_fields import _rounded
from blockwise.plans.sql_base import sql
from blockwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict = {}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _q(name: str, body: str | None = None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body) if base else body
        return f

    return put


# ---- runs: three clusterings of every block (first label, last label, venue alone)

_F1 = "coalesce(2 * {0} * {1} / nullif({0} + {1}, 0), 0)"
_RUNS = """, lab3 AS (SELECT 'first' AS run_id, name, paper_id, label FROM vgroups UNION ALL SELECT 'last', blk.name, blk.paper_id, coalesce(l.label, 'missing:' || blk.paper_id) FROM blk LEFT JOIN vlast l USING (name, paper_id) UNION ALL SELECT 'venue', name, paper_id, label FROM vlab),
rcell AS (SELECT p.run_id, t.name, t.label AS t, p.label AS p, count(*) AS n FROM tru t JOIN lab3 p USING (name, paper_id) GROUP BY ALL),
rcells AS (SELECT *, sum(n) OVER (PARTITION BY run_id, name, t) AS ts, sum(n) OVER (PARTITION BY run_id, name, p) AS ps FROM rcell),
rm AS (SELECT run_id, name, coalesce(tp / nullif(pp, 0), 0) AS pp_, coalesce(tp / nullif(tt, 0), 0) AS pr_, bp, br, tc, pc FROM (SELECT run_id, name, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp, sum(n * n / ps) / sum(n) AS bp, sum(n * n / ts) / sum(n) AS br, count(DISTINCT t) AS tc, count(DISTINCT p) AS pc FROM rcells GROUP BY run_id, name)),
runs AS (SELECT run_id, name, pp_ AS pairwise_precision, pr_ AS pairwise_recall, """ + _F1.format("pp_", "pr_") + """ AS pairwise_f1, bp AS b3_precision, br AS b3_recall, """ + _F1.format("bp", "br") + """ AS b3_f1, tc AS true_clusters, pc AS predicted_clusters FROM rm)
"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    truth, v, b = cut_lineage(tb.truth(spark, d)), cut_lineage(tb.venue_clusters(spark, d)), cut_lineage(tb.blocks(spark, d))
    first = lb.normalized_groups(v, b, ["name"]).withColumn("run_id", F.lit("first"))
    last = lb.complete_labels(b, lb.assigned_label(v, ["name"], "last"), ["name"]).withColumn("run_id", F.lit("last"))
    venue = tb.venue_labels(spark, d).withColumn("run_id", F.lit("venue"))
    pred = first.unionByName(last).unionByName(venue)
    tall = truth.withColumn("run_id", F.explode(F.array(F.lit("first"), F.lit("last"), F.lit("venue"))))
    return cut_lineage(mt.scores(tall, pred, ["run_id", "name"]))


@_q("c06_run_metrics", _RUNS + "SELECT run_id, name, round(pairwise_f1, 6) AS pairwise_f1, round(b3_f1, 6) AS b3_f1, true_clusters, predicted_clusters FROM runs")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(runs(spark, d).select("run_id", "name", "pairwise_f1", "b3_f1", "true_clusters", "predicted_clusters"))


@_q("a15_combination_summary", _RUNS + "SELECT run_id, count(*) AS completed_author_blocks, round(avg(b3_f1), 6) AS macro_average_b3_f1, round(median(b3_f1), 6) AS median_b3_f1, round(min(b3_f1), 6) AS min_b3_f1, round(max(b3_f1), 6) AS max_b3_f1 FROM runs GROUP BY run_id")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.combination_summary(runs(spark, d), ["b3_f1"], "run_id"))


@_q("a16_macro_rows", _RUNS + "SELECT run_id, name, round(b3_f1, 6) AS b3_f1 FROM runs UNION ALL SELECT run_id, 'MACRO_AVERAGE', round(avg(b3_f1), 6) FROM runs GROUP BY run_id")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.with_macro_row(runs(spark, d), ["b3_f1"], "run_id"))


@_q("j07_baseline_delta", _RUNS + "SELECT r.name, r.run_id AS condition, round(r.b3_f1, 6) AS value, round(b.b3_f1, 6) AS baseline, round(r.b3_f1 - b.b3_f1, 6) AS delta FROM runs r LEFT JOIN runs b ON b.name = r.name AND b.run_id = 'first'")
def j07(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.baseline_delta(runs(spark, d).withColumnRenamed("run_id", "condition"), "b3_f1", "first"))


@_q("a20_a21_condition_summary", _RUNS + ", dl AS (SELECT r.run_id AS condition, r.b3_f1 AS v, r.b3_f1 - b.b3_f1 AS x FROM runs r LEFT JOIN runs b ON b.name = r.name AND b.run_id = 'first') SELECT condition, round(avg(v), 6) AS mean_b3_f1, round(median(v), 6) AS median_b3_f1, round(avg(x), 6) AS mean_delta, round(median(x), 6) AS median_delta, count_if(x > 1e-12) AS improved, count_if(x < -1e-12) AS degraded, count_if(abs(x) <= 1e-12) AS unchanged, 0 AS parse_failure_count FROM dl GROUP BY condition")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.condition_summary(runs(spark, d).withColumnRenamed("run_id", "condition"), "b3_f1", "first"))


@_q("a22_repeat_stability", _RUNS + "SELECT name, count(*) AS repetitions, round(avg(b3_f1), 6) AS mean, round(stddev_pop(b3_f1), 6) AS standard_deviation, round(min(b3_f1), 6) AS minimum, round(max(b3_f1), 6) AS maximum, round(max(b3_f1) - min(b3_f1), 6) AS range FROM runs GROUP BY name")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.repeat_stability(runs(spark, d), "b3_f1", repetition="run_id"))


_COV = ", c AS (SELECT name, count_if(best = papers) AS f, count(*) AS t FROM acov GROUP BY name)"


@_q("a23_run_summary", _RUNS + _COV + " SELECT run_id, count(*) AS names, round(avg(pairwise_precision), 6) AS average_pairwise_precision, round(avg(pairwise_recall), 6) AS average_pairwise_recall, round(avg(pairwise_f1), 6) AS average_pairwise_f1, sum(f)::BIGINT AS fully_covered_authors, sum(t)::BIGINT AS total_authors, round(sum(f) / sum(t), 6) AS overall_complete_author_coverage FROM runs JOIN c USING (name) GROUP BY run_id")
def a23(spark: SparkSession, d: str) -> DataFrame:
    cov = mt.complete_author_coverage(tb.truth(spark, d), tb.venue_clusters(spark, d), ["name"]).drop("rate")
    return _rounded(an.run_summary(runs(spark, d).join(cov, "name")))


@_q("w03_ranked_blocks", _RUNS + "SELECT name, round(b3_f1, 6) AS b3_f1, row_number() OVER (ORDER BY round(b3_f1, 9), name) AS rank FROM runs WHERE run_id = 'first'")
def w03(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("run_id = 'first'").select("name", F.round("b3_f1", 9).alias("b3_f1"))
    return _rounded(an.ranked(r, "b3_f1"))


@_q("w13_w14_combination_ranking", _RUNS + ", s AS (SELECT run_id AS combination, avg(b3_f1) AS f, avg(b3_recall) AS r FROM runs GROUP BY run_id) SELECT combination, round(f, 6) AS f1, round(r, 6) AS recall, row_number() OVER (ORDER BY f IS NULL, round(coalesce(nullif(f, 0), -1), 9) DESC, round(coalesce(nullif(r, 0), -1), 9) DESC, combination) AS rank FROM s")
def w13(spark: SparkSession, d: str) -> DataFrame:
    s = runs(spark, d).groupBy(F.col("run_id").alias("combination")).agg(F.round(F.avg("b3_f1"), 9).alias("f1"), F.round(F.avg("b3_recall"), 9).alias("recall"))
    return _rounded(an.combination_ranking(s, "f1", "recall"))


@_q("w16_best_condition", _RUNS + "SELECT name, run_id, round(b3_f1, 6) AS b3_f1 FROM runs QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(b3_f1, 9) DESC, run_id) = 1")
def w16(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select("name", "run_id", F.round("b3_f1", 9).alias("b3_f1"))
    return _rounded(an.best_row(r, ["name"], "b3_f1", "run_id"))


@_q("w15_largest_changes", _RUNS + ", dl AS (SELECT r.name, r.run_id, abs(r.b3_f1 - b.b3_f1) AS x FROM runs r JOIN runs b ON b.name = r.name AND b.run_id = 'first') SELECT name, run_id, round(x, 6) AS change FROM dl ORDER BY round(x, 9) DESC, name, run_id LIMIT 8")
def w15(spark: SparkSession, d: str) -> DataFrame:
    dl = an.baseline_delta(runs(spark, d), "b3_f1", "first", condition="run_id").select("name", "run_id", F.round(F.abs("delta"), 9).alias("change"))
    return _rounded(dl.orderBy(F.col("change").desc(), "name", "run_id").limit(8))


@_q("a31_median_papers", "SELECT median(n) AS median_papers FROM (SELECT count(*) AS n FROM blk GROUP BY name)")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median_papers"))


@_q("a32_standardized", _RUNS + ", r AS (SELECT * FROM runs WHERE run_id = 'first'), s AS (SELECT avg(b3_f1) AS m1, stddev_pop(b3_f1) AS s1, avg(predicted_clusters) AS m2, stddev_pop(predicted_clusters) AS s2 FROM r) SELECT name, round(coalesce((b3_f1 - m1) / nullif(s1, 0), 0), 6) AS b3_f1, round(coalesce((predicted_clusters - m2) / nullif(s2, 0), 0), 6) AS predicted_clusters FROM r, s")
def a32(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("run_id = 'first'").select("name", "b3_f1", F.col("predicted_clusters").cast("double").alias("predicted_clusters"))
    return _rounded(an.standardized(r, ["b3_f1", "predicted_clusters"]))


@_q("j11_covered_truth_groups", "SELECT name, author FROM acov WHERE best = papers")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return mt.author_coverage(tb.truth(spark, d), tb.venue_clusters(spark, d), ["name"]).where("fully_covered").select("name", "author")


@_q("j12_a25_refined_clusters", ", mixed AS (SELECT name, cluster_index FROM best GROUP BY ALL HAVING count(DISTINCT author) > 1), kids AS (SELECT v.name, v.cluster_index AS parent, v.paper_id, tru.label AS a FROM vcl v JOIN mixed USING (name, cluster_index) JOIN tru USING (name, paper_id)), kn AS (SELECT name, parent, paper_id, dense_rank() OVER (PARTITION BY name, parent ORDER BY a) - 1 AS child FROM kids) SELECT name, cluster_index::VARCHAR AS cluster, paper_id FROM vcl ANTI JOIN mixed USING (name, cluster_index) UNION ALL SELECT name, parent || '.' || child, paper_id FROM kn")
def j12(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v, truth = tb.venue_clusters(spark, d), tb.truth(spark, d)
    mixed = sl.mixed_clusters(mt.compositions(truth, v, ["name"]), ["name"])
    kids = v.join(mixed, ["name", "cluster_index"]).join(truth.select("name", "paper_id", F.col("label").alias("a")), ["name", "paper_id"])
    child = F.dense_rank().over(Window.partitionBy("name", "cluster_index").orderBy("a")) - 1
    children = kids.select("name", F.col("cluster_index").alias("parent_index"), "paper_id", child.alias("child_index"))
    return an.replaced_clusters(v.select("name", "cluster_index", "paper_id"), children, ["name"])


@_q("j13_truth_subset", "SELECT name, label AS author_id, paper_id FROM tru SEMI JOIN (SELECT DISTINCT name, paper_id FROM uni) USING (name, paper_id)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    asked = tb.response_universe(spark, d).select("name", "paper_id").distinct()
    return tb.truth(spark, d).join(asked, ["name", "paper_id"], "left_semi").select("name", F.col("label").alias("author_id"), "paper_id")


@_q("f04_preferred_pool", _RUNS + ", cv AS (SELECT name, count(*) AS paper_count FROM blk GROUP BY name), oc AS (SELECT name, sum((len(list_filter(organization, lambda x: x <> '')) > 0)::INT) AS o, sum((len(coauthors) > 0)::INT) AS c FROM cards GROUP BY name), p AS (SELECT r.name, paper_count, coalesce(o, 0) / paper_count AS o, coalesce(c, 0) / paper_count AS c, CASE WHEN b3_f1 >= 0.9 THEN 'easy' WHEN b3_f1 >= 0.8 THEN 'medium' ELSE 'hard' END AS difficulty FROM runs r JOIN cv USING (name) LEFT JOIN oc USING (name) WHERE run_id = 'first'), q AS (SELECT *, paper_count <= median(paper_count) OVER (PARTITION BY difficulty) AND o >= 0.7 AND c >= 0.9 AS ok FROM p) SELECT name, difficulty FROM q QUALIFY ok OR count_if(ok) OVER (PARTITION BY difficulty) = 0")
def f04(spark: SparkSession, d: str) -> DataFrame:
    b = tb.blocks(spark, d)
    r = runs(spark, d).where("run_id = 'first'").select("name", sl.band(F.col("b3_f1")).alias("difficulty"))
    return sl.preferred_pool(r.join(fl.coverage(tb.cards(spark, d), b), "name")).select("name", "difficulty")


@_q("w10_stratified_sample", _RUNS + ", b AS (SELECT name, CASE WHEN b3_f1 >= 0.9 THEN 'easy' WHEN b3_f1 >= 0.8 THEN 'medium' WHEN b3_f1 IS NOT NULL THEN 'hard' END AS difficulty FROM runs WHERE run_id = 'first') SELECT name, difficulty FROM b QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5(name || chr(31) || '42'), name) <= 2")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks per difficulty, by a seeded order."""
    from pyspark.sql import Window

    r = runs(spark, d).where("run_id = 'first'").select("name", sl.band(F.col("b3_f1")).alias("difficulty"))
    return r.withColumn("r", F.row_number().over(Window.partitionBy("difficulty").orderBy(sl.seeded_order(42, "name"), "name"))).where("r <= 2").drop("r")


@_q("w11_smallest_choice", "SELECT name, n AS paper_count FROM (SELECT name, count(*) AS n FROM blk GROUP BY name) ORDER BY n, name LIMIT 10")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("paper_count")).orderBy("paper_count", "name").limit(10)


# ---- responses

_PARSE = "WITH r AS (SELECT DISTINCT response_id, content FROM cluster_responses), c AS (SELECT response_id, regexp_replace(trim(coalesce(content, ''), E' \\t\\n\\r'), '^```(?:json)?\\s*|\\s*```$', '', 'g') AS t FROM r), s AS (SELECT response_id, t, CASE WHEN json_valid(t) THEN t WHEN strpos(t, '{') > 0 AND length(t) - strpos(reverse(t), '}') + 1 > strpos(t, '{') AND strpos(t, '}') > 0 AND json_valid(substr(t, strpos(t, '{'), length(t) - strpos(reverse(t), '}') + 2 - strpos(t, '{'))) THEN substr(t, strpos(t, '{'), length(t) - strpos(reverse(t), '}') + 2 - strpos(t, '{')) END AS j FROM c)"


@_q("r01_parse_content", _PARSE + " SELECT response_id, CASE WHEN t = '' THEN 'empty' WHEN j IS NULL THEN 'invalid' WHEN json_type(j, '$.clusters') = 'ARRAY' OR json_type(j, '$.assignments') = 'OBJECT' THEN 'ok' ELSE 'no clusters' END AS status FROM s", base=False)
def r01(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "cluster_responses").select("response_id", "content").distinct()
    return a.select("response_id", rs.parsed("content").getField("status").alias("status"))


@_q("r02_envelope", "SELECT DISTINCT response_id, CASE WHEN trim(coalesce(content, ''), E' \\t\\n\\r') = '' AND finish_reason IN ('length', 'max_tokens') THEN 'thinking consumed the output budget' WHEN trim(coalesce(content, ''), E' \\t\\n\\r') = '' THEN 'empty final content' WHEN finish_reason IN ('length', 'max_tokens') THEN 'token limit reached before the JSON was complete' END AS error FROM cluster_responses", base=False)
def r02(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "cluster_responses").select("response_id", rs.envelope_error(F.col("content"), F.col("finish_reason")).alias("error")).distinct()


@_q("r03_clusters", _PARSE + ", k AS (SELECT response_id, j, unnest(json_keys(j, '$.assignments')) AS key, generate_subscripts(json_keys(j, '$.assignments'), 1) - 1 AS pos FROM s WHERE json_type(j, '$.assignments') = 'OBJECT' AND coalesce(json_type(j, '$.clusters'), '') <> 'ARRAY'), v AS (SELECT response_id, pos, try_cast(key AS INT) AS record_index, json_extract_string(j, '$.assignments.\"' || key || '\"') AS c, j FROM k) SELECT response_id, min(pos) OVER (PARTITION BY response_id, c) AS cluster_index, coalesce(json_extract_string(j, '$.labels.\"' || c || '\"'), 'cluster ' || c) AS label, pos, record_index FROM v", base=False)
def r03(spark: SparkSession, d: str) -> DataFrame:
    return rs.clusters_of_answers(read_table(spark, d, "cluster_responses").select("response_id", "content").distinct())


@_q("r04_display_ids", ", di AS (SELECT name, paper_id, 'P' || row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) AS display_id FROM cards) SELECT name, display_id, paper_id FROM di UNION ALL SELECT DISTINCT name, 'P0', 'P0' FROM di")
def r04(spark: SparkSession, d: str) -> DataFrame:
    known = fl.indexed_cards(tb.cards(spark, d).select("name", "paper_id", "record_index", "title"), ["title"]).select("name", "display_id", "paper_id")
    asked = known.select("name", "display_id").unionByName(known.select("name", F.lit("P0").alias("display_id")).distinct())
    return rs.display_to_paper(asked, known)


@_q("r05_recover_truncated")
def r05(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "cluster_requests").select("request_id", "paper_count").dropDuplicates(["request_id"])
    a = read_table(spark, d, "cluster_responses").select("response_id", "request_id", "content").distinct().join(q, "request_id")
    return rs.recover_truncated(a)


@_q("r06_usage", "SELECT DISTINCT response_id, coalesce(nullif(completion_tokens, 0), length(coalesce(content, '')) // 4) AS output_tokens FROM cluster_responses", base=False)
def r06(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "cluster_responses").select("response_id", rs.usage(F.col("completion_tokens"), F.col("content")).alias("output_tokens")).distinct()


@_q("r07_failures", "SELECT q.request_id, CASE WHEN count(r.response_id) = 0 THEN 'not_run' WHEN count_if(r.finish_reason IN ('length', 'max_tokens')) > 0 THEN 'length' ELSE 'other' END AS failure FROM (SELECT DISTINCT request_id FROM cluster_requests) q LEFT JOIN cluster_responses r ON q.request_id = r.request_id GROUP BY q.request_id HAVING coalesce(count_if(r.finish_reason IN ('stop', 'end_turn') AND r.content IS NOT NULL), 0) = 0", base=False)
def r07(spark: SparkSession, d: str) -> DataFrame:
    return rs.failure_kind(read_table(spark, d, "cluster_requests"), read_table(spark, d, "cluster_responses"))


@_q("s07_k09_latest_failed", "SELECT request_id, arg_max(response_id, (received_at, response_id)) AS response_id FROM cluster_responses WHERE NOT coalesce(finish_reason IN ('stop', 'end_turn'), false) GROUP BY request_id", base=False)
def s07(spark: SparkSession, d: str) -> DataFrame:
    return rs.latest_failed(read_table(spark, d, "cluster_responses"))


# ---- contexts and prompts


@_q("w08_similarity_chain")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return pm.similarity_chain(tb.cards(spark, d))


@_q("w09_random_order")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return pm.random_order(tb.cards(spark, d), pm.SEEDS[0])


@_q("t16_t17_contexts")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return pm.contexts(tb.cards(spark, d))


@_q("v04_same_information", """SELECT name, condition, count(*) AS records, true AS same FROM cards, (VALUES ('original_flat:0'), ('chronological_order:0'), ('organization_grouped:0'), ('coauthor_network:0'), ('multifield_similarity:0'), ('random_order:0'), ('random_order:1'), ('random_order:2')) c(condition) GROUP BY ALL""")
def v04(spark: SparkSession, d: str) -> DataFrame:
    cards = cut_lineage(tb.cards(spark, d))
    info = sm.numbered(cards).select("name", "i", "title", "organization", "coauthors")
    c = pm.contexts(cards).withColumn("condition", F.concat_ws(":", "condition", F.col("repetition").cast("string"))).join(info, ["name", "i"])
    return lb.same_information(c.withColumnRenamed("i", "record_index"), ["title", "organization", "coauthors"])


# the records of a block as text and as JSON, as the prompts hold them
_TEXTS = """, num AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) - 1 AS i FROM cards),
rec AS (SELECT name, i, concat_ws(chr(10), 'Paper ID: P' || (i + 1), 'Title: ' || coalesce(title, ''), 'Organization: ' || array_to_string(list_filter(organization, lambda x: x <> ''), '; '), 'Coauthors: ' || array_to_string(list_filter(coauthors, lambda x: x <> ''), '; ')) AS t,
  to_json({'record_index': i, 'title': coalesce(title, ''), 'organization': organization, 'coauthors': coauthors})::VARCHAR AS j FROM num)
"""


@_q("v05_q05_q06_prompt_invariance", _TEXTS + "SELECT name, 5 AS variants, 1 AS contexts, md5(chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10)) AS context_md5 FROM rec GROUP BY name")
def v05(spark: SparkSession, d: str) -> DataFrame:
    """The five instructions of every block: what stands between instruction and contract is the same text in all."""
    cards = cut_lineage(tb.cards(spark, d))
    all_five = [pm.block_prompts(cards, k, as_text=True).withColumns({"instruction": F.lit(t), "contract": F.lit(pm.CONTRACT)}) for k, t in pm.INSTRUCTIONS.items()]
    return lb.prompt_variants(reduce(DataFrame.unionByName, all_five))


@_q("q01_q04_block_prompts", _TEXTS + f"SELECT name, concat_ws(chr(10) || chr(10), 'Author name: ' || name, {_lit(pm.INSTRUCTIONS['evidence_guidance'])}, string_agg(j, chr(10) ORDER BY i), {_lit(pm.CONTRACT)}) AS prompt FROM rec GROUP BY name")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return pm.block_prompts(tb.cards(spark, d), "evidence_guidance")


@_q("q03_split_prompts", _TEXTS + f", mixed AS (SELECT name, cluster_index FROM best GROUP BY ALL HAVING count(DISTINCT author) > 1) SELECT name, cluster_index, concat_ws(chr(10) || chr(10), {_lit(pm.SPLIT_TASK)}, string_agg(j, chr(10) ORDER BY i), {_lit(pm.CONTRACT)}) AS prompt FROM (SELECT DISTINCT v.name, v.cluster_index, num.i FROM vcl v JOIN mixed USING (name, cluster_index) JOIN num ON num.name = v.name AND num.paper_id = v.paper_id) m JOIN rec USING (name, i) GROUP BY ALL")
def q03(spark: SparkSession, d: str) -> DataFrame:
    v = tb.venue_clusters(spark, d)
    mixed = sl.mixed_clusters(mt.compositions(tb.truth(spark, d), v, ["name"]), ["name"])
    return pm.split_prompt(v.join(mixed, ["name", "cluster_index"]).select("name", "cluster_index", "paper_id").join(sm.numbered(tb.cards(spark, d)), ["name", "paper_id"]))


@_q("q07_t12_prompt_size", _TEXTS + f"SELECT name, count(*) AS papers, ((sum(length(j)) + count(*) - 1 + {pm.FIXED_LENGTH} + length(name)) // 4)::BIGINT AS tokens, ((sum(length(j)) + count(*) - 1 + {pm.FIXED_LENGTH} + length(name)) // 4) / count(*) AS tokens_per_paper FROM rec GROUP BY name")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return pm.prompt_size(tb.cards(spark, d))


# ---- router

_SCORED = _RUNS + """, sc AS (SELECT r.name, round(r.b3_f1, 9) AS b3_f1, r.b3_precision, r.b3_recall, (r.b3_f1 >= 0.85)::INT AS rel, (r.b3_f1 < 0.8)::INT AS hard, c.paper_count, round((coalesce(t, 0) + coalesce(o, 0) + coalesce(co, 0)) / c.paper_count / 3, 9) AS p
  FROM runs r JOIN (SELECT name, count(*) AS paper_count FROM blk GROUP BY name) c USING (name) LEFT JOIN (SELECT name, sum((coalesce(length(title), 0) > 0)::INT) AS t, sum((len(list_filter(organization, lambda x: x <> '')) > 0)::INT) AS o, sum((len(coauthors) > 0)::INT) AS co FROM cards GROUP BY name) k USING (name) WHERE run_id = 'first'),
cu AS (SELECT 'coverage' AS model_name, row_number() OVER w AS k, sum(rel) OVER w AS r, count(*) OVER () AS n, sum(hard) OVER () AS h, sum(hard) OVER w AS hk, sum(b3_f1) OVER w AS f FROM sc WINDOW w AS (ORDER BY p DESC, name ROWS UNBOUNDED PRECEDING))
"""
_CURVE = "k AS accepted_authors, round(r / k, 6) AS accepted_precision, round(k / n, 6) AS coverage, round((h - hk) / nullif(h, 0), 6) AS hard_block_recall, round(f / k, 6) AS accepted_mean_b3_f1"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    cov = fl.coverage(tb.cards(spark, d), tb.blocks(spark, d)).select("name", "paper_count", F.round("overall_coverage", 9).alias("predicted_probability"))
    r = sl.error_flags(runs(spark, d).where("run_id = 'first'").select("name", "b3_f1", "b3_precision", "b3_recall")).withColumn("b3_f1", F.round("b3_f1", 9))
    return r.join(cov, "name").withColumn("model_name", F.lit("coverage"))


@_q("w04_coverage_curve", _SCORED + f"SELECT model_name, {_CURVE} FROM cu")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.coverage_curve(_scored(spark, d)))


@_q("w05_coverage_checkpoints", _SCORED + f"SELECT model_name, {_CURVE}, t AS target_coverage FROM cu, (VALUES (0.2::DOUBLE), (0.4), (0.6), (0.8), (1.0)) v(t) WHERE k = ceil(t * n)")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.coverage_checkpoints(rt.coverage_curve(_scored(spark, d))))


_SWEEP = ", sw AS (SELECT t AS threshold, coalesce(count_if(p >= t), 0) AS accepted_authors, avg(CASE WHEN p >= t THEN rel END) AS pr, coalesce(count_if(p >= t), 0) / count(*) AS cov, coalesce(count_if(p < t AND hard = 1), 0) / nullif(count_if(hard = 1), 0) AS hr, avg(CASE WHEN p >= t THEN b3_f1 END) AS f FROM sc, (SELECT unnest(range(50, 100, 5)) / 100 AS t) GROUP BY t)"
_SW = "threshold, accepted_authors, round(pr, 6) AS accepted_precision, round(cov, 6) AS coverage, round(hr, 6) AS hard_block_recall, round(f, 6) AS accepted_mean_b3_f1"


@_q("w06_threshold_sweep", _SCORED + _SWEEP + f" SELECT {_SW} FROM sw")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.threshold_sweep(_scored(spark, d)))


@_q("w06_chosen_threshold", _SCORED + _SWEEP + f" SELECT {_SW} FROM sw WHERE pr IS NOT NULL ORDER BY pr >= 0.9 DESC, CASE WHEN pr >= 0.9 THEN cov ELSE pr END DESC, CASE WHEN pr >= 0.9 THEN pr ELSE cov END DESC, threshold LIMIT 1")
def w06b(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.choose_threshold(rt.threshold_sweep(_scored(spark, d))))


@_q("a27_failure_modes", _SCORED + "SELECT coalesce(count_if(b3_precision < 0.8 AND b3_recall >= 0.8), 0) AS low_precision_only, coalesce(count_if(b3_precision >= 0.8 AND b3_recall < 0.8), 0) AS low_recall_only, coalesce(count_if(b3_precision < 0.8 AND b3_recall < 0.8), 0) AS both_low, coalesce(count_if(b3_precision >= 0.8 AND b3_recall >= 0.8), 0) AS neither FROM sc WHERE hard = 1")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return rt.failure_modes(_scored(spark, d))


@_q("a28_selection_metrics", _SCORED + "SELECT count_if(p >= 0.9) AS accepted_authors, round(avg(CASE WHEN p >= 0.9 THEN rel END), 6) AS accepted_precision, round(count_if(p >= 0.9) / count(*), 6) AS coverage, round(count_if(p < 0.9 AND hard = 1) / nullif(count_if(hard = 1), 0), 6) AS hard_block_recall, round(avg(CASE WHEN p >= 0.9 THEN b3_f1 END), 6) AS accepted_mean_b3_f1 FROM sc")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.selection_metrics(_scored(spark, d), F.col("predicted_probability") >= 0.9))


@_q("a29_rank_correlations", _SCORED + ", x AS (SELECT 'paper_count' AS feature, paper_count::DOUBLE AS x, b3_f1 AS y FROM sc UNION ALL SELECT 'predicted_probability', p, b3_f1 FROM sc), rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM x) SELECT feature, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM rk GROUP BY feature")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.rank_correlations(_scored(spark, d), ["paper_count", "predicted_probability"]))


@_q("t11_title_symbols", ", t AS (SELECT name, coalesce(title, '') AS t, regexp_extract_all(coalesce(title, ''), '[^\\s\\p{Z}]+') AS w FROM cards), s AS (SELECT name, length(regexp_replace(t, '[\\s\\p{Z}]', '', 'g')) AS c, length(regexp_replace(t, '[^\\p{Nd}]', '', 'g')) AS d, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS l, len(w) AS w, len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) AS a, len(list_filter(w, lambda x: length(regexp_replace(x, '[^\\p{L}]', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(x, '[^\\p{L}]', '', 'g'), '[^\\p{Lu}]'))) AS u, len(list_filter(w, lambda x: (regexp_matches(x, '\\p{L}') AND regexp_matches(x, '\\p{Nd}')) OR (regexp_matches(x, '[\\p{L}\\p{N}]') AND regexp_matches(x, '[=+*/^]')))) AS f FROM t) SELECT name, round(coalesce(sum(d) / nullif(sum(c), 0), 0), 6) AS title_digit_ratio, round(coalesce(sum(c - l) / nullif(sum(c), 0), 0), 6) AS title_non_alphabetic_ratio, round(coalesce(sum(u) / nullif(sum(a), 0), 0), 6) AS title_uppercase_token_ratio, round(coalesce(sum(f) / nullif(sum(w), 0), 0), 6) AS title_formula_like_token_ratio FROM s GROUP BY name")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rt.title_symbols(tb.cards(spark, d)))


def labelled_features(spark: SparkSession, d: str) -> DataFrame:
    f = cut_lineage(rt.block_features(tb.cards(spark, d), tb.blocks(spark, d)))
    release(spark)  # the features' files are gone before the runs write theirs
    scores = sl.error_flags(runs(spark, d).where("run_id = 'first'").select("name", "b3_f1"))
    return cut_lineage(lb.require_one_to_one(f, scores, ["name"]))


@_q("t13_block_features")
def t13(spark: SparkSession, d: str) -> DataFrame:
    return rt.block_features(tb.cards(spark, d), tb.blocks(spark, d))


@_q("m03_cross_validated")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return rt.cross_validated(labelled_features(spark, d))


@_q("m05_m06_final_model")
def m05(spark: SparkSession, d: str) -> DataFrame:
    """The held-out blocks with their probability and decision at the threshold chosen out of fold on the others."""
    df = cut_lineage(rt.split_blocks(labelled_features(spark, d)))
    model, threshold = rt.final_model(df.where("part = 'train'"))
    frozen = rt.predict(model, df.where("part = 'test'"))
    return frozen.select("name", "b3_f1", "predicted_probability", (F.col("predicted_probability") >= F.lit(threshold)).alias("accepted"))


@_q("m06_importance")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the model of the training blocks."""
    return rt.importance(rt.fit_model(rt.split_blocks(labelled_features(spark, d)).where("part = 'train'"), rt.FEATURES))


@_q("m02_split_blocks", "SELECT name, CASE WHEN row_number() OVER (ORDER BY md5(name || chr(31) || '42'), name) <= (SELECT round(count(*) * 0.8) FROM (SELECT DISTINCT name FROM blk)) THEN 'train' ELSE 'test' END AS part FROM (SELECT DISTINCT name FROM blk)")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return rt.split_blocks(tb.blocks(spark, d).select("name").distinct()).select("name", "part")
