"""Queries of refinements, condition studies, contexts as prompts, whole envelopes, choices and the command reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, read_table
from blockwise.functions.fields import alnum_coauthor_set, coverage
from blockwise.operators import analysis as an
from blockwise.operators import labels as lb
from blockwise.operators import metrics as mt
from blockwise.operators import prompts as pm
from blockwise.operators import refinement as rf
from blockwise.operators import responses as rs
from blockwise.operators import selection as sl
from blockwise.operators import similarity as sm
from blockwise.plans import q_fields, q_runs, q_similarity
from blockwise.plans.q_fields import _rounded
from blockwise.plans.q_runs import _RUNS, _TEXTS, _lit, runs
from blockwise.plans.sql_base import sql
from blockwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, body: str | None = None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body) if base else body
        return f

    return put


# ---- labels numbered on

@_q("l04_numbered_singletons", ", m AS (SELECT blk.*, f.label, count(DISTINCT f.label) OVER (PARTITION BY blk.name) AS n FROM blk LEFT JOIN vfirst f USING (name, paper_id)) SELECT name, paper_id, coalesce(label, (n + row_number() OVER (PARTITION BY name, label IS NULL ORDER BY record_index, paper_id) - 1)::VARCHAR) AS label FROM m")
def l04(spark: SparkSession, d: str) -> DataFrame:
    return lb.numbered_singletons(tb.blocks(spark, d), lb.assigned_label(tb.venue_clusters(spark, d), ["name"]), ["name"], ["record_index", "paper_id"])


# ---- refinement: children of a mixed cluster are its papers by year

_KIDS = """, mixed AS (SELECT name, cluster_index FROM best GROUP BY ALL HAVING count(DISTINCT author) > 1),
kids AS (SELECT DISTINCT v.name, v.cluster_index AS parent_index, v.paper_id, coalesce(year, '') AS child_index FROM vcl v JOIN mixed USING (name, cluster_index) JOIN cards USING (name, paper_id)),
kcell AS (SELECT k.name, k.parent_index, t.label AS t, k.child_index AS p, count(*) AS n FROM kids k JOIN tru t USING (name, paper_id) GROUP BY ALL),
ksum AS (SELECT *, sum(n) OVER (PARTITION BY name, parent_index, t) AS ts, sum(n) OVER (PARTITION BY name, parent_index, p) AS ps FROM kcell),
krep AS (SELECT name, parent_index, sum(n)::BIGINT AS papers, count(DISTINCT t) AS authors, count(DISTINCT p) AS child_clusters, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM ksum GROUP BY ALL),
mrg AS (SELECT name, cluster_index::VARCHAR AS c, paper_id FROM vcl ANTI JOIN mixed USING (name, cluster_index) UNION ALL SELECT name, parent_index || '.' || child_index, paper_id FROM kids),
mlab AS (SELECT blk.name, blk.paper_id, coalesce(m.c, 'missing:' || blk.paper_id) AS label FROM blk LEFT JOIN (SELECT name, paper_id, min(c) AS c FROM mrg GROUP BY ALL) m USING (name, paper_id)),
mcell AS (SELECT t.name, t.label AS t, p.label AS p, count(*) AS n FROM tru t JOIN mlab p USING (name, paper_id) GROUP BY ALL),
msum AS (SELECT *, sum(n) OVER (PARTITION BY name, t) AS ts, sum(n) OVER (PARTITION BY name, p) AS ps FROM mcell),
mpw AS (SELECT name, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS rc FROM (SELECT name, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM msum GROUP BY name)),
mbest AS (SELECT name, author, max(n) AS best FROM (SELECT t.name, t.label AS author, m.c, count(DISTINCT t.paper_id) AS n FROM tru t JOIN mrg m USING (name, paper_id) GROUP BY ALL) GROUP BY ALL),
mcov AS (SELECT count_if(coalesce(b.best, 0) = a.papers) AS f, count(*) AS t FROM (SELECT name, label AS author, count(*) AS papers FROM tru GROUP BY ALL) a LEFT JOIN mbest b USING (name, author)),
mrep AS (SELECT round(avg(pr), 6) AS average_pairwise_precision, round(avg(rc), 6) AS average_pairwise_recall, round(avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)), 6) AS average_pairwise_f1, (SELECT f FROM mcov)::BIGINT AS fully_covered_authors, (SELECT t FROM mcov)::BIGINT AS total_authors,
  round((SELECT f / t FROM mcov), 6) AS complete_author_coverage, (SELECT count(*) FROM (SELECT DISTINCT name, parent_index FROM kids)) AS refined_parent_clusters FROM mpw)
"""


def _children(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v, truth = cut_lineage(tb.venue_clusters(spark, d)), cut_lineage(tb.truth(spark, d))
    mixed = sl.mixed_clusters(mt.compositions(truth, v, ["name"]), ["name"])
    years = tb.cards(spark, d).select("name", "paper_id", F.coalesce("year", F.lit("")).alias("child_index"))
    kids = v.join(mixed, ["name", "cluster_index"]).join(years, ["name", "paper_id"]).select("name", F.col("cluster_index").alias("parent_index"), "child_index", "paper_id").distinct()
    return truth, v, cut_lineage(kids)


@_q("a25_refined_parents", _KIDS + "SELECT name, parent_index, papers, authors, child_clusters, round(coalesce(tp / nullif(pp, 0), 0), 6) AS pairwise_precision, round(coalesce(tp / nullif(tt, 0), 0), 6) AS pairwise_recall FROM krep")
def a25_parents(spark: SparkSession, d: str) -> DataFrame:
    truth, _, kids = _children(spark, d)
    return _rounded(rf.refined_parents(truth, kids, ["name"]).select("name", "parent_index", "papers", "authors", "child_clusters", "pairwise_precision", "pairwise_recall"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    truth, v, kids = _children(spark, d)
    return rf.refinement_report(truth, v, kids, tb.blocks(spark, d), ["name"])


@_q("a25_refinement_report", _KIDS + "SELECT * FROM mrep")
def a25_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_report(spark, d))


@_q("a26_w14_refinement_sweep", _KIDS + "SELECT * EXCLUDE (o), row_number() OVER (ORDER BY o DESC, combination) AS rank FROM (SELECT combination, status, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS o, r.* FROM (VALUES ('year', 'completed'), ('title', 'not_run'), ('title+year', 'not_run')) v(combination, status) LEFT JOIN mrep r ON status = 'completed')")
def a26(spark: SparkSession, d: str) -> DataFrame:
    found = _report(spark, d).withColumn("combination", F.lit("year"))
    asked = spark.createDataFrame([("title",), ("title+year",), ("title",)], "combination string")
    return _rounded(rf.sweep_summary(asked, found))


@_q("u04_combinations", "SELECT DISTINCT field_set AS combination FROM cluster_requests WHERE field_set IS NOT NULL UNION SELECT * FROM (VALUES ('title'), ('title+organization+coauthors'))", base=False)
def u04(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("title",), ("title+organization+coauthors",)], "combination string")
    return rf.all_combinations(asked, read_table(spark, d, "cluster_requests").where("field_set is not null").select(F.col("field_set").alias("combination")))


# ---- condition studies

_OK = ", st AS (SELECT name, run_id AS condition, b3_f1, pairwise_f1, predicted_clusters::DOUBLE AS clusters, NOT (run_id = 'last' AND true_clusters < 3) AND run_id <> 'venue' AS ok FROM runs)"


def _study(spark: SparkSession, d: str) -> DataFrame:
    ok = ~((F.col("run_id") == "last") & (F.col("true_clusters") < 3)) & (F.col("run_id") != "venue")
    return runs(spark, d).select("name", F.col("run_id").alias("condition"), "b3_f1", "pairwise_f1", F.col("predicted_clusters").cast("double").alias("clusters"), ok.alias("parse_success"))


@_q("a21_prompt_summary", _RUNS + _OK + " SELECT c AS condition, round(avg(b3_f1) FILTER (ok), 6) AS mean_b3_f1, round(avg(pairwise_f1) FILTER (ok), 6) AS mean_pairwise_f1, round(median(b3_f1) FILTER (ok), 6) AS median_b3_f1, count(*) FILTER (NOT ok) AS parse_failure_count FROM (VALUES ('first'), ('last'), ('venue'), ('none')) v(c) LEFT JOIN st ON condition = c GROUP BY c")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """One condition has failed everywhere and one was never run: both have null means."""
    return _rounded(an.prompt_summary(_study(spark, d), ["b3_f1", "pairwise_f1"], ["first", "last", "venue", "none"]))


@_q("a21_prompt_deltas", _RUNS + _OK + " SELECT r.name, r.condition, round(b.b3_f1, 6) AS first_b3_f1, round(r.b3_f1, 6) AS condition_b3_f1, round(r.b3_f1 - b.b3_f1, 6) AS delta_b3_f1, b.clusters AS first_clusters, r.clusters AS condition_clusters, r.clusters - b.clusters AS delta_clusters FROM st r JOIN st b ON b.name = r.name AND b.condition = 'first' AND b.ok WHERE r.ok AND r.condition <> 'first'")
def a21_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.prompt_deltas(_study(spark, d), ["b3_f1", "clusters"], "first"))


@_q("c04_condition_matrix", _RUNS + "SELECT name, round(avg(b3_f1) FILTER (run_id = 'first'), 6) AS first, round(avg(b3_f1) FILTER (run_id = 'last'), 6) AS last, round(avg(b3_f1) FILTER (run_id = 'venue'), 6) AS venue FROM runs GROUP BY name")
def c04(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(an.condition_matrix(runs(spark, d).withColumnRenamed("run_id", "condition"), "b3_f1", ["first", "last", "venue"], "name").select("name", "first", "last", "venue"))


@_q("a23_complete_runs", _RUNS + q_runs._COV + ", per AS (SELECT run_id, count(*) AS names, avg(pairwise_f1) AS f, sum(f)::DOUBLE / sum(t) AS c FROM runs JOIN c USING (name) GROUP BY run_id), l AS (SELECT 'average_pairwise_f1' AS metric, f AS v, names FROM per UNION ALL SELECT 'overall_complete_author_coverage', c, names FROM per) SELECT metric, count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM l WHERE names = (SELECT max(names) FROM per) GROUP BY metric")
def a23_complete(spark: SparkSession, d: str) -> DataFrame:
    cov = mt.complete_author_coverage(tb.truth(spark, d), tb.venue_clusters(spark, d), ["name"]).drop("rate")
    per = cut_lineage(an.run_summary(runs(spark, d).join(cov, "name")))
    most = per.agg(F.max("names")).first()[0] or 0  # one row
    return _rounded(an.complete_run_summary(per, ["average_pairwise_f1", "overall_complete_author_coverage"], most))


@_q("w15_example_cases", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY author_block, paper_i, paper_j) AS place FROM ({q_similarity.SQL['j08_changed_pairs']}) j) WHERE place <= CASE change_type WHEN 'fixed_false_split' THEN 3 WHEN 'fixed_false_merge' THEN 3 ELSE 2 END", base=False)
def w15_cases(spark: SparkSession, d: str) -> DataFrame:
    limits = {"fixed_false_split": 3, "fixed_false_merge": 3, "introduced_false_split": 2, "introduced_false_merge": 2}
    return an.first_changed_pairs(q_similarity.known_papers(spark, d), *q_similarity._two(spark, d), limits)


_BANDS = ", b AS (SELECT name, round(b3_f1, 9) AS f, CASE WHEN b3_f1 >= 0.9 THEN 'easy' WHEN b3_f1 >= 0.8 THEN 'medium' WHEN b3_f1 IS NOT NULL THEN 'hard' END AS difficulty FROM runs WHERE run_id = 'first')"


@_q("w17_chart_order", _RUNS + _BANDS + " SELECT name, difficulty, row_number() OVER (ORDER BY list_position(['easy', 'medium', 'hard'], difficulty), -f, name) AS place FROM b")
def w17(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("run_id = 'first'").select("name", (-F.round("b3_f1", 9)).alias("_f"), sl.band(F.col("b3_f1")).alias("difficulty"))
    keyed = r.withColumn("_d", sl.category_key(F.col("difficulty"), ["easy", "medium", "hard"]))
    from blockwise.common import numbered_within

    return numbered_within(keyed, [], ["_d", "_f", "name"], "place").select("name", "difficulty", (F.col("place") + 1).alias("place"))


@_q("w11_seeded_choice", _RUNS + _BANDS + """, cv AS (SELECT name, count(*) AS paper_count FROM blk GROUP BY name), oc AS (SELECT name, sum((len(list_filter(organization, lambda x: x <> '')) > 0)::INT) AS o, sum((len(coauthors) > 0)::INT) AS c FROM cards GROUP BY name),
p AS (SELECT b.name, difficulty, paper_count, paper_count <= median(paper_count) OVER (PARTITION BY difficulty) AND coalesce(o, 0) / paper_count >= 0.7 AND coalesce(c, 0) / paper_count >= 0.9 AS good FROM b JOIN cv USING (name) LEFT JOIN oc USING (name) WHERE difficulty IS NOT NULL),
q AS (SELECT *, count_if(good) OVER (PARTITION BY difficulty) AS n FROM p), s AS (SELECT * FROM q WHERE good OR n = 0 QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY paper_count, name) <= 10)
SELECT name, difficulty, paper_count FROM s QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5(name || chr(31) || '42'), name) = 1""")
def w11_choice(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("run_id = 'first'").select("name", sl.band(F.col("b3_f1")).alias("difficulty"))
    return sl.seeded_choice(r.join(coverage(tb.cards(spark, d), tb.blocks(spark, d)), "name")).select("name", "difficulty", "paper_count")


# ---- envelopes

@_q("r02_whole_envelope", """SELECT response_id, CASE WHEN finish_reason = 'content_filter' THEN 'API error: content_filter' WHEN content IS NULL THEN 'response contains no choices'
WHEN e AND c AND completion_tokens > 0 THEN 'thinking consumed the output budget' WHEN e THEN 'empty final content' WHEN c THEN 'token limit reached before the JSON was complete' END AS error
FROM (SELECT DISTINCT response_id, content, finish_reason, completion_tokens, trim(coalesce(content, ''), E' \\t\\n\\r') = '' AS e, coalesce(finish_reason IN ('length', 'max_tokens'), false) AS c FROM cluster_responses)""", base=False)
def r02_whole(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes made of the responses: a filtered one as an error, one without content as one without choices."""
    r = read_table(spark, d, "cluster_responses").select("response_id", "content", "finish_reason", "completion_tokens").distinct()
    error = F.when(F.col("finish_reason") == "content_filter", F.col("finish_reason"))
    thought = F.when(F.col("completion_tokens") > 0, "thought")
    return r.select("response_id", rs.whole_envelope_error(error, F.col("content").isNotNull().cast("int"), F.col("content"), F.col("finish_reason"), thought).alias("error"))


@_q("k09_stale_failures", "SELECT f.request_id, f.response_id FROM (SELECT request_id, arg_max(response_id, (received_at, response_id)) AS response_id FROM cluster_responses WHERE NOT coalesce(finish_reason IN ('stop', 'end_turn'), false) GROUP BY request_id) f SEMI JOIN (SELECT request_id FROM cluster_responses WHERE finish_reason IN ('stop', 'end_turn') AND content IS NOT NULL) g ON g.request_id = f.request_id", base=False)
def k09(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "cluster_responses")
    return rs.stale_failures(rs.latest_failed(r), sl.completed(r))


# ---- contexts that SQL can say, and their prompts

_F = q_fields.SQL
_ORDER = f""", ctx AS (
SELECT name, 'original_flat' AS condition, 0 AS repetition, NULL::INT AS group_no, i AS position, i FROM num
UNION ALL SELECT w.name, 'chronological_order', 0, NULL, w.place - 1, num.i FROM ({_F["w07_chronological"]}) w JOIN num ON num.name = w.name AND num.paper_id = w.paper_id
UNION ALL SELECT g.name, 'organization_grouped', 0, g.group_no, row_number() OVER (PARTITION BY g.name ORDER BY g.group_no, num.i) - 1, num.i FROM ({_F["t15_organization_groups"]}) g JOIN num ON num.name = g.name AND num.paper_id = g.paper_id
UNION ALL SELECT g.name, 'coauthor_network', 0, g.group_no, row_number() OVER (PARTITION BY g.name ORDER BY g.group_no, num.i) - 1, num.i
  FROM (SELECT name, paper_id, dense_rank() OVER (PARTITION BY name ORDER BY component) AS group_no FROM ({q_similarity.SQL["t14_coauthor_components"]}) t) g JOIN num ON num.name = g.name AND num.paper_id = g.paper_id)
"""
_SAID = ["original_flat", "chronological_order", "organization_grouped", "coauthor_network"]


@_q("t17_sorted_and_grouped_contexts", _TEXTS + _ORDER + "SELECT * FROM ctx")
def t17_said(spark: SparkSession, d: str) -> DataFrame:
    return pm.contexts(tb.cards(spark, d), _SAID)


@_q("q02_t16_context_prompts", _TEXTS + _ORDER + f""", flat AS (SELECT name, condition, repetition, string_agg(j, ',' ORDER BY position) AS body FROM ctx JOIN rec USING (name, i) WHERE group_no IS NULL GROUP BY ALL),
grp AS (SELECT name, condition, repetition, group_no, '{{"group":"Group ' || group_no || '","papers":[' || string_agg(j, ',' ORDER BY position) || ']}}' AS g FROM ctx JOIN rec USING (name, i) WHERE group_no IS NOT NULL GROUP BY name, condition, repetition, group_no),
bodies AS (SELECT * FROM flat UNION ALL SELECT name, condition, repetition, string_agg(g, ',' ORDER BY group_no) FROM grp GROUP BY name, condition, repetition)
SELECT name, condition, repetition, concat_ws(chr(10) || chr(10), replace({_lit(pm.CONTEXT_TASK)}, '{{name}}', name), {_lit(pm.CONTRACT)}, 'PAPERS:' || chr(10) || '[' || body || ']') AS prompt FROM bodies""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of the arrangements that SQL can say; those of the others come from the same operator."""
    cards = cut_lineage(tb.cards(spark, d))
    return pm.context_prompts(pm.contexts(cards, _SAID), cards)


@_q("q07_dry_run", _TEXTS + ", a AS (SELECT name, count(DISTINCT label) AS authors FROM tru GROUP BY name) SELECT c.name, count(*) AS papers, coalesce(any_value(authors), 0) AS authors, (sum(length(j)) + count(*) - 1)::BIGINT AS record_characters, count_if(coalesce(length(title), 0) > 0) AS with_title, count_if(len(list_filter(organization, lambda x: x <> '')) > 0) AS with_organization, count_if(len(coauthors) > 0) AS with_coauthors FROM num c JOIN rec USING (name, i) LEFT JOIN a ON a.name = c.name GROUP BY c.name")
def q07_dry(spark: SparkSession, d: str) -> DataFrame:
    return pm.dry_run(tb.cards(spark, d), tb.truth(spark, d))


# ---- the 27 features, from the queries of their parts

_S = q_similarity.SQL
_AGREE = "avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))))"
_wide = lambda cols: ", ".join(f"max(CASE WHEN view = '{v}' THEN {c} END) AS {v}_{n}" for v in ("title", "organization", "coauthor") for c, n in cols)


@_q("t13_block_features", f"""SELECT c.name, c.paper_count::DOUBLE AS paper_count, title_coverage, organization_coverage, coauthor_coverage, overall_coverage, p.tokens::DOUBLE AS estimated_prompt_tokens, round(p.tokens_per_paper, 6) AS tokens_per_paper,
  s.* EXCLUDE (name), n.* EXCLUDE (name), a.* EXCLUDE (name), t.* EXCLUDE (name)
FROM ({_F["a12_coverage_router"]}) c LEFT JOIN ({q_runs.SQL["q07_t12_prompt_size"]}) p ON p.name = c.name
LEFT JOIN (SELECT name, {_wide([("pairwise_similarity_mean", "pairwise_similarity_mean"), ("pairwise_similarity_std", "pairwise_similarity_std")])} FROM ({_S["t09_pair_statistics"]}) x GROUP BY name) s ON s.name = c.name
LEFT JOIN (SELECT name, {_wide([("nearest_neighbor_similarity_mean", "nearest_neighbor_similarity_mean"), ("nearest_neighbor_margin_mean", "nearest_neighbor_margin_mean")])} FROM ({_S["w02_nearest_margin"]}) x GROUP BY name) n ON n.name = c.name
LEFT JOIN (SELECT name, round(max(CASE WHEN first = 'title' AND second = 'organization' THEN agreement END), 6) AS title_organization_neighbor_agreement, round(max(CASE WHEN first = 'title' AND second = 'coauthor' THEN agreement END), 6) AS title_coauthor_neighbor_agreement,
  round(max(CASE WHEN first = 'organization' AND second = 'coauthor' THEN agreement END), 6) AS organization_coauthor_neighbor_agreement, round(avg(agreement), 6) AS mean_cross_view_agreement FROM ({_S["t10_j14_neighbour_agreement"].replace(f"round({_AGREE}, 6)", _AGREE)}) x GROUP BY name) a ON a.name = c.name
LEFT JOIN ({q_runs.SQL["t11_title_symbols"]}) t ON t.name = c.name""", base=False)
def t13_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(q_runs.QUERIES["t13_block_features"](spark, d))


# ---- fields of pairs by the policies of the context study

@_q("t05_t08_context_similarity", q_similarity._NUM + """, k AS (SELECT name, i, paper_id, list_distinct(list_filter(list_transform(coauthors, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '')) AS co, list_distinct(regexp_extract_all(lower(array_to_string(organization, ' ')), '[a-z0-9]+')) AS o FROM num WHERE i < 12),
p AS (SELECT a.name, a.i, b.i AS j, CASE WHEN len(a.o) + len(b.o) > 0 THEN len(list_intersect(a.o, b.o)) / len(list_distinct(list_concat(a.o, b.o))) END AS oj, CASE WHEN len(a.co) + len(b.co) > 0 THEN len(list_intersect(a.co, b.co)) / len(list_distinct(list_concat(a.co, b.co))) END AS cj FROM k a JOIN k b ON a.name = b.name AND a.i < b.i)
SELECT name, i, j, round(oj, 6) AS organization_jaccard, round(cj, 6) AS coauthor_jaccard, round((coalesce(oj, 0) + coalesce(cj, 0)) / nullif((oj IS NOT NULL)::INT + (cj IS NOT NULL)::INT, 0), 6) AS mean_similarity FROM p""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve records of every block against each other (the context study looks at openings of prompts)."""
    from blockwise.functions.fields import organization_tokens

    p = sm.numbered(tb.cards(spark, d)).where("i < 12").select("name", "i", organization_tokens().alias("o"), alnum_coauthor_set().alias("co"))
    q = sm.block_pairs(p, ["i", "o", "co"])
    oj, cj = sm.jaccard(F.col("o_i"), F.col("o_j"), "both"), sm.jaccard(F.col("co_i"), F.col("co_j"), "both")
    return _rounded(q.select("name", F.col("i_i").alias("i"), F.col("i_j").alias("j"), oj.alias("organization_jaccard"), cj.alias("coauthor_jaccard"), sm.mean_of_available(oj, cj).alias("mean_similarity")))
