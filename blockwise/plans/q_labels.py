"""Queries of label construction, validation and clustering metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions import fields as fl
from blockwise.operators import labels as lb
from blockwise.operators import metrics as mt
from blockwise.operators import selection
from blockwise.plans.q_fields import _rounded
from blockwise.plans.sql_base import sql
from blockwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict = {}
RUN = ["response_id", "name"]
BLOCK = ["name"]


def _q(name: str, body: str | None = None):
    def put(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body)
        return f

    return put


def _groups(spark, d):
    return lb.normalized_groups(tb.venue_clusters(spark, d), tb.blocks(spark, d), BLOCK)


@_q("l01_first_label", "SELECT * FROM vfirst")
def l01(spark: SparkSession, d: str) -> DataFrame:
    return lb.assigned_label(tb.venue_clusters(spark, d), BLOCK)


@_q("l02_last_label", "SELECT * FROM vlast")
def l02(spark: SparkSession, d: str) -> DataFrame:
    return lb.assigned_label(tb.venue_clusters(spark, d), BLOCK, "last")


@_q("l03_missing_singletons", "SELECT blk.name, blk.paper_id, coalesce(l.label, 'missing:' || blk.paper_id) AS label FROM blk LEFT JOIN vlast l USING (name, paper_id)")
def l03(spark: SparkSession, d: str) -> DataFrame:
    return lb.complete_labels(tb.blocks(spark, d), lb.assigned_label(tb.venue_clusters(spark, d), BLOCK, "last"), BLOCK)


@_q("l05_normalized_groups", "SELECT * FROM vgroups")
def l05(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


@_q("l06_flat_names", "SELECT DISTINCT name || '_' || cluster_index AS flat, regexp_replace(name || '_' || cluster_index, '_[0-9]+$', '') AS name FROM vcl")
def l06(spark: SparkSession, d: str) -> DataFrame:
    flat = tb.venue_clusters(spark, d).select(F.concat_ws("_", "name", F.col("cluster_index").cast("string")).alias("flat")).distinct()
    return flat.select("flat", lb.flat_prediction_name(F.col("flat")).alias("name"))


@_q("l07_distinct_in_cluster", "SELECT response_id, name, cluster_index, paper_id, min(pos) AS pos FROM rcl GROUP BY ALL")
def l07(spark: SparkSession, d: str) -> DataFrame:
    return lb.distinct_in_cluster(tb.response_clusters(spark, d), RUN)


_V = """, agg AS (SELECT response_id, name, count_if(NOT expected) AS n_unknown, coalesce(count_if(clusters > 1), 0) AS n_repeated, sum(coalesce(rows - 1, 0)) AS n_duplicate, count_if(expected AND rows IS NULL) AS n_missing,
  coalesce(array_to_string(list_sort(list(paper_id) FILTER (expected AND rows IS NULL))[1:5], ','), '') AS first_missing FROM viol GROUP BY ALL),
nc AS (SELECT response_id, name, count(DISTINCT cluster_index) AS n_clusters FROM rcl GROUP BY ALL),
v AS (SELECT agg.response_id, agg.name, coalesce(n_clusters, 0) AS n_clusters, n_unknown, n_repeated, n_duplicate, n_missing, first_missing FROM agg LEFT JOIN nc ON agg.response_id = nc.response_id AND agg.name = nc.name)
"""


@_q("v01_validate", _V + "SELECT *, CASE WHEN n_clusters = 0 THEN 'empty' WHEN n_unknown > 0 THEN 'unknown' WHEN n_repeated > 0 THEN 'repeated' WHEN n_missing > 0 THEN 'missing' ELSE 'ok' END AS status FROM v")
def v01(spark: SparkSession, d: str) -> DataFrame:
    return lb.violations(tb.response_clusters(spark, d), tb.response_universe(spark, d), RUN)


@_q("v02_validate_ordered", _V + "SELECT response_id, name, CASE WHEN n_unknown > 0 THEN 'unknown' WHEN n_repeated > 0 THEN 'repeated' WHEN n_missing > 0 THEN 'missing' WHEN n_clusters = 0 THEN 'empty' ELSE 'ok' END AS status FROM v")
def v02(spark: SparkSession, d: str) -> DataFrame:
    return lb.ordered_check(tb.response_clusters(spark, d), tb.response_universe(spark, d), RUN)


@_q("v03_validate_counts", _V + "SELECT response_id, name, CASE WHEN n_duplicate > 0 THEN 'duplicate' WHEN n_unknown > 0 THEN 'unknown' WHEN n_missing > 0 THEN 'missing' ELSE 'ok' END AS status FROM v")
def v03(spark: SparkSession, d: str) -> DataFrame:
    return lb.count_check(tb.response_clusters(spark, d), tb.response_universe(spark, d), RUN)


@_q("v06_complete", _V + "SELECT response_id, name, n_unknown = 0 AND n_missing = 0 AS complete FROM v")
def v06(spark: SparkSession, d: str) -> DataFrame:
    return lb.is_complete(tb.response_clusters(spark, d), tb.response_universe(spark, d), RUN)


@_q("v07_expected_count", "SELECT name, count(*) AS paper_count FROM blk GROUP BY name")
def v07(spark: SparkSession, d: str) -> DataFrame:
    sizes = tb.blocks(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("paper_count"))
    return lb.require_count(sizes, tb.blocks(spark, d).select("name").distinct().count(), "blocks")


@_q("j02_one_to_one", "SELECT name, paper_count, round(pr, 6) AS pairwise_precision FROM (SELECT name, count(*) AS paper_count FROM blk GROUP BY name) JOIN pw USING (name)")
def j02(spark: SparkSession, d: str) -> DataFrame:
    sizes = tb.blocks(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("paper_count"))
    return _rounded(lb.require_one_to_one(sizes, _pairwise(spark, d).select("name", "pairwise_precision"), BLOCK))


def _table(spark, d):
    return mt.contingency(tb.truth(spark, d), _groups(spark, d), BLOCK)


def _pairwise(spark, d):
    return mt.pairwise(_table(spark, d), BLOCK)


@_q("j04_contingency", "SELECT * FROM cells")
def j04(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d)


_F1 = "coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)"


@_q("a01_pairwise_metrics", f"SELECT name, papers, round(pr, 6) AS pairwise_precision, round(rc, 6) AS pairwise_recall, round({_F1}, 6) AS pairwise_f1 FROM pw")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_pairwise(spark, d))


@_q("a02_pairwise_last_label", """, l AS (SELECT t.name, t.label AS t, coalesce(v.label, 'missing:' || t.paper_id) AS p, count(*) AS n FROM tru t LEFT JOIN vlast v USING (name, paper_id) GROUP BY ALL),
ls AS (SELECT *, sum(n) OVER (PARTITION BY name, t) AS ts, sum(n) OVER (PARTITION BY name, p) AS ps FROM l),
w AS (SELECT name, sum(n) AS papers, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM ls GROUP BY name),
s AS (SELECT name, papers, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS rc FROM w)
SELECT name, papers, round(pr, 6) AS pairwise_precision, round(rc, 6) AS pairwise_recall, round(""" + _F1 + ", 6) AS pairwise_f1 FROM s")
def a02(spark: SparkSession, d: str) -> DataFrame:
    truth = tb.truth(spark, d)
    pred = lb.complete_labels(truth, lb.assigned_label(tb.venue_clusters(spark, d), BLOCK, "last"), BLOCK)
    return _rounded(mt.pairwise(mt.contingency(truth, pred, BLOCK), BLOCK))


@_q("a03_b_cubed", f"SELECT name, round(pr, 6) AS b3_precision, round(rc, 6) AS b3_recall, round({_F1}, 6) AS b3_f1 FROM b3")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.b_cubed(_table(spark, d), BLOCK))


_KT = ", kt AS (SELECT u.response_id, u.name, u.paper_id, t.label FROM uni u JOIN tru t USING (name, paper_id)), rf AS (SELECT response_id, name, paper_id, arg_min(cluster_index, (cluster_index, pos))::VARCHAR AS label FROM rcl GROUP BY ALL)"


@_q("a04_cluster_analysis", _V + _KT + """, g AS (SELECT u.response_id, u.name, u.paper_id, coalesce(rf.label, 'missing:' || u.paper_id) AS label FROM uni u LEFT JOIN rf ON u.response_id = rf.response_id AND u.name = rf.name AND u.paper_id = rf.paper_id),
c AS (SELECT kt.response_id, kt.name, kt.label AS t, g.label AS p, count(*) AS n FROM kt JOIN g USING (response_id, name, paper_id) GROUP BY ALL),
cs AS (SELECT *, sum(n) OVER (PARTITION BY response_id, name, t) AS ts, sum(n) OVER (PARTITION BY response_id, name, p) AS ps FROM c),
w AS (SELECT response_id, name, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM cs GROUP BY ALL),
s AS (SELECT response_id, name, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS rc FROM w),
wd AS (SELECT response_id, name, count(*) AS k FROM (SELECT response_id, name, cluster_index, paper_id FROM rcl GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
rv AS (SELECT response_id, name, count(DISTINCT paper_id) AS k FROM rcl SEMI JOIN uni USING (response_id, name, paper_id) GROUP BY ALL),
ac AS (SELECT response_id, name, count_if(b = n) AS full, count(*) AS total FROM (SELECT response_id, name, label, max(n) AS n, coalesce(max(b), 0) AS b FROM (
  SELECT a.response_id, a.name, a.label, a.n, x.b FROM (SELECT response_id, name, label, count(*) AS n FROM kt GROUP BY ALL) a LEFT JOIN (SELECT kt.response_id, kt.name, kt.label, rcl.cluster_index, count(DISTINCT kt.paper_id) AS b FROM kt JOIN rcl USING (response_id, name, paper_id) GROUP BY ALL) x USING (response_id, name, label)) GROUP BY ALL) GROUP BY ALL)
SELECT v.response_id, v.name, n_clusters AS llm_clusters, coalesce(rv.k, 0) AS returned_valid_papers, n_missing AS missing_papers, n_unknown AS unknown_papers, n_repeated AS cross_cluster_duplicates, coalesce(wd.k, 0) AS within_cluster_duplicates,
  round(pr, 6) AS pairwise_precision, round(rc, 6) AS pairwise_recall, round(""" + "CASE WHEN pr IS NOT NULL THEN " + _F1 + " END" + """, 6) AS pairwise_f1, ac.full AS fully_covered_authors, ac.total AS total_authors, round(ac.full / ac.total, 6) AS complete_author_coverage
FROM v LEFT JOIN s USING (response_id, name) LEFT JOIN wd USING (response_id, name) LEFT JOIN rv USING (response_id, name) LEFT JOIN ac USING (response_id, name)""")
def a04(spark: SparkSession, d: str) -> DataFrame:
    uni = tb.response_universe(spark, d)
    truth = uni.join(tb.truth(spark, d), BLOCK + ["paper_id"])
    return _rounded(mt.cluster_analysis(truth, tb.response_clusters(spark, d), uni, RUN))


@_q("a05_compositions", "SELECT name, cluster_index, author, n FROM best")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return mt.compositions(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK)


@_q("a06_within_duplicates", "SELECT response_id, name, cluster_index, paper_id, count(*) AS times FROM rcl GROUP BY ALL HAVING count(*) > 1")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return mt.duplicates(tb.response_clusters(spark, d), RUN)[0]


@_q("a06_across_duplicates", "SELECT name, paper_id, array_to_string(list_sort(list(DISTINCT cluster_index)), ',') AS cluster_indexes FROM vcl GROUP BY ALL HAVING count(DISTINCT cluster_index) > 1")
def a06b(spark: SparkSession, d: str) -> DataFrame:
    return mt.duplicates(tb.venue_clusters(spark, d), BLOCK)[1]


@_q("a07_author_coverage", "SELECT name, author, papers, best AS best_cluster_papers, round(best / papers, 6) AS best_cluster_ratio, best = papers AS fully_covered FROM acov")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.author_coverage(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK))


@_q("a07_complete_author_coverage", "SELECT name, count_if(best = papers) AS fully_covered_authors, count(*) AS total_authors, round(count_if(best = papers) / count(*), 6) AS rate FROM acov GROUP BY name")
def a07b(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.complete_author_coverage(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK))


@_q("a08_coarse_report", """, z AS (SELECT name, cluster_index, count(DISTINCT paper_id) AS n FROM vcl GROUP BY ALL), zz AS (SELECT name, count(*) AS k, max(n) AS m FROM z GROUP BY name), tt AS (SELECT name, count(*) AS n FROM tru GROUP BY name),
cc AS (SELECT name, count_if(best = papers) AS f, count(*) AS t FROM acov GROUP BY name)
SELECT name, f AS real_authors_fully_covered, t AS real_authors_total, round(f / t, 6) AS coarse_recall, coalesce(k, 0) AS coarse_clusters, coalesce(m, 0) AS largest_cluster, round(coalesce(m, 0) / tt.n, 6) AS largest_cluster_ratio FROM cc LEFT JOIN zz USING (name) JOIN tt USING (name)""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.coarse_report(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK))


@_q("a09_missing_by_author", "SELECT name, label AS author, count(DISTINCT paper_id) AS n_missing FROM tru ANTI JOIN vcl USING (name, paper_id) GROUP BY ALL")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return mt.missing_by_author(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK)


_SHAPE = "SELECT name, count(*) AS cluster_count, count_if(s = 1) / count(*) AS singleton_ratio, max(s / papers) AS largest_cluster_ratio, -sum(s / papers * log2(s / papers)) AS size_entropy FROM (SELECT name, label, count(*) AS s, sum(count(*)) OVER (PARTITION BY name) AS papers FROM {} GROUP BY name, label) GROUP BY name"


@_q("a10_cluster_statistics", f", q AS ({_SHAPE.format('vgroups')}) SELECT name, cluster_count, round(singleton_ratio, 6) AS singleton_ratio, round(largest_cluster_ratio, 6) AS largest_cluster_ratio, round(size_entropy, 6) AS size_entropy FROM q")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.cluster_statistics(_groups(spark, d), BLOCK))


@_q("a11_cluster_count_ratio", f", t AS ({_SHAPE.format('tru')}), p AS ({_SHAPE.format('vgroups')}) SELECT name, round(p.cluster_count / t.cluster_count, 6) AS cluster_count_ratio, round(log2(p.cluster_count / t.cluster_count), 6) AS log2_cluster_count_ratio, p.cluster_count - t.cluster_count AS cluster_count_bias FROM t JOIN p USING (name)")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.cluster_count_ratio(mt.cluster_statistics(tb.truth(spark, d), BLOCK), mt.cluster_statistics(_groups(spark, d), BLOCK), BLOCK))


@_q("a13_macro_average", f"SELECT round(coalesce(avg({_F1}), 0), 6) AS macro_average, count(*) AS blocks FROM pw")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.macro_average(_pairwise(spark, d)))


_PART = """, gaps AS (SELECT t.name, count_if(v.paper_id IS NULL) AS gaps FROM tru t LEFT JOIN vfirst v USING (name, paper_id) GROUP BY t.name)"""


@_q("a14_partial_evaluation", _PART + """, c AS (SELECT t.name, t.label AS t, v.label AS p, count(*) AS n FROM tru t JOIN vfirst v USING (name, paper_id) WHERE t.name IN (SELECT name FROM gaps WHERE gaps = 0) GROUP BY ALL),
cs AS (SELECT *, sum(n) OVER (PARTITION BY name, t) AS ts, sum(n) OVER (PARTITION BY name, p) AS ps FROM c),
w AS (SELECT name, sum(n) AS papers, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM cs GROUP BY name),
s AS (SELECT name, papers, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS rc FROM w)
SELECT name, papers, round(pr, 6) AS pairwise_precision, round(rc, 6) AS pairwise_recall, round(""" + _F1 + ", 6) AS pairwise_f1 FROM s")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.partial_evaluation(tb.truth(spark, d), lb.assigned_label(tb.venue_clusters(spark, d), BLOCK), BLOCK)[0])


@_q("a14_partial_counts", _PART + " SELECT count_if(gaps = 0) AS evaluated, count_if(gaps > 0) AS incomplete, (SELECT count(DISTINCT name) FROM vcl WHERE name NOT IN (SELECT name FROM tru)) AS without_truth FROM gaps WHERE name IN (SELECT name FROM vcl)")
def a14b(spark: SparkSession, d: str) -> DataFrame:
    return mt.partial_evaluation(tb.truth(spark, d), lb.assigned_label(tb.venue_clusters(spark, d), BLOCK), BLOCK)[1]


@_q("f05_mixed_clusters", "SELECT name, cluster_index FROM best GROUP BY ALL HAVING count(DISTINCT author) > 1")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return selection.mixed_clusters(mt.compositions(tb.truth(spark, d), tb.venue_clusters(spark, d), BLOCK), BLOCK)


@_q("f03_f07_error_bands", f", s AS (SELECT name, {_F1} AS f FROM b3) SELECT name, round(f, 6) AS b3_f1, CASE WHEN f >= 0.9 THEN 'easy' WHEN f >= 0.8 THEN 'medium' ELSE 'hard' END AS difficulty, (f >= 0.85)::INT AS reliable_085, (f < 0.8)::INT AS hard_080, (f < 0.5)::INT AS catastrophic_050 FROM s")
def f03(spark: SparkSession, d: str) -> DataFrame:
    b = mt.b_cubed(_table(spark, d), BLOCK).select("name", "b3_f1")
    return _rounded(selection.error_flags(b.withColumn("difficulty", selection.band(F.col("b3_f1")))))


@_q("f08_hardest_blocks", f", s AS (SELECT name, {_F1} AS f FROM b3) SELECT name, round(f, 6) AS b3_f1 FROM s WHERE f < 0.5")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.hardest(mt.b_cubed(_table(spark, d), BLOCK).select("name", "b3_f1"), "b3_f1", 0.5))


@_q("j09_predicted_with_truth", "SELECT DISTINCT name FROM vcl SEMI JOIN tru USING (name)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    return tb.venue_clusters(spark, d).select("name").distinct().join(tb.truth(spark, d), "name", "left_semi")


@_q("j10_missing_papers", "SELECT response_id, name, paper_id FROM uni ANTI JOIN rcl USING (response_id, name, paper_id)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return tb.response_universe(spark, d).join(tb.response_clusters(spark, d), RUN + ["paper_id"], "left_anti")


@_q("c05_metric_mart", f""", bad AS (SELECT name, count_if(k > 1) AS rep FROM (SELECT name, paper_id, count(DISTINCT cluster_index) AS k FROM vcl GROUP BY ALL) GROUP BY name),
t AS ({_SHAPE.format('tru')}), p AS ({_SHAPE.format('vgroups')}),
st AS (SELECT b.name, CASE WHEN bad.name IS NULL THEN 'missing_result' WHEN rep > 0 THEN 'error' ELSE 'completed' END AS status FROM (SELECT DISTINCT name FROM blk) b LEFT JOIN bad USING (name))
SELECT st.name, status, CASE WHEN status = 'error' THEN 'papers in multiple clusters' END AS error_reason, CASE WHEN status = 'completed' THEN round(coalesce(2 * b3.pr * b3.rc / nullif(b3.pr + b3.rc, 0), 0), 6) END AS b3_f1,
  CASE WHEN status = 'completed' THEN p.cluster_count - t.cluster_count END AS bias FROM st LEFT JOIN b3 USING (name) LEFT JOIN t USING (name) LEFT JOIN p USING (name)""")
def c05(spark: SparkSession, d: str) -> DataFrame:
    blocks = tb.blocks(spark, d)
    mart = mt.metric_mart(tb.truth(spark, d), tb.venue_clusters(spark, d), blocks, fl.coverage(tb.cards(spark, d), blocks), blocks)
    return _rounded(mart.select("name", "status", "error_reason", "b3_f1", F.col("cluster_count_bias").alias("bias")))


@_q("a30_status_histogram", _V + ", s AS (SELECT CASE WHEN n_clusters = 0 THEN 'empty' WHEN n_unknown > 0 THEN 'unknown' WHEN n_repeated > 0 THEN 'repeated' WHEN n_missing > 0 THEN 'missing' ELSE 'ok' END AS status FROM v) SELECT status, count(*) AS n FROM s GROUP BY status")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return lb.violations(tb.response_clusters(spark, d), tb.response_universe(spark, d), RUN).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
