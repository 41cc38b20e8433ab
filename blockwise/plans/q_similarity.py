"""Queries of similarity, neighbours, pairs, graph and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.functions.fields import alnum_coauthor_set
from blockwise.operators import analysis as an
from blockwise.operators import graph, similarity as sm
from blockwise.operators import labels as lb
from blockwise.plans.q_fields import _COSET, _rounded
from blockwise.plans.sql_base import sql
from blockwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict = {}

_NUM = f""",
num AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) - 1 AS i FROM cards),
tt AS (SELECT name, i, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+')) AS terms, trim(regexp_replace(lower(coalesce(title, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) <> '' AS ok FROM num),
nd AS (SELECT name, count(*) AS n FROM num GROUP BY name),
tf AS (SELECT name, i, t, count(*) AS tf FROM (SELECT name, i, unnest(terms) AS t FROM tt) GROUP BY ALL),
tw AS (SELECT name, i, t, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY name, t))) + 1) AS w FROM tf JOIN nd USING (name)),
tn AS (SELECT name, i, t, w / sqrt(sum(w * w) OVER (PARTITION BY name, i)) AS w FROM tw),
tdot AS (SELECT a.name, a.i, b.i AS j, sum(a.w * b.w) AS s FROM tn a JOIN tn b ON a.name = b.name AND a.t = b.t AND a.i <> b.i GROUP BY ALL),
os AS (SELECT name, i, list_distinct(regexp_extract_all(lower(array_to_string(organization, ' ')), '[a-z0-9]+')) AS s FROM num),
cs AS (SELECT name, i, {_COSET} AS s FROM num),
av AS (SELECT name, 'title' AS view, i, NULL AS s FROM tt WHERE ok UNION ALL SELECT name, 'organization', i, s FROM os WHERE len(s) > 0 UNION ALL SELECT name, 'coauthor', i, s FROM cs WHERE len(s) > 0),
sim AS (SELECT a.name, a.view, a.i, b.i AS j, round(CASE WHEN a.view = 'title' THEN coalesce(tdot.s, 0) ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 9) AS s
  FROM av a JOIN av b ON a.name = b.name AND a.view = b.view AND a.i <> b.i LEFT JOIN tdot ON a.view = 'title' AND tdot.name = a.name AND tdot.i = a.i AND tdot.j = b.i),
rk AS (SELECT *, row_number() OVER (PARTITION BY name, view, i ORDER BY s DESC, j DESC) AS r FROM sim)
"""


def _q(name: str, body: str | None = None):
    def put(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body)
        return f

    return put


def _stats(spark, d):
    return sm.neighbour_statistics(sm.views(tb.cards(spark, d)))


@_q("t01_tfidf_weights", _NUM + "SELECT name, i, t AS term, round(w, 6) AS weight FROM tn")
def t01(spark: SparkSession, d: str) -> DataFrame:
    p = sm.numbered(tb.cards(spark, d)).select("name", "i", sm.title_tokens("title").alias("terms"))
    return _rounded(sm.tfidf(p, ["name"]))


@_q("t09_pair_statistics", _NUM + "SELECT name, view, count(*) // 2 AS pairs, round(avg(s), 6) AS pairwise_similarity_mean, round(stddev_pop(s), 6) AS pairwise_similarity_std FROM sim GROUP BY ALL")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sm.pair_statistics(_stats(spark, d)))


@_q("w01_top3_neighbours", _NUM + "SELECT name, view, i, r AS rank, j, round(s, 6) AS similarity FROM rk WHERE r <= 3")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sm.top_neighbours(_stats(spark, d)))


@_q("w02_nearest_margin", _NUM + ", f AS (SELECT name, view, i, max(CASE WHEN r = 1 THEN s END) AS a, max(CASE WHEN r = 2 THEN s END) AS b FROM rk WHERE r <= 2 GROUP BY ALL) SELECT name, view, round(avg(a), 6) AS nearest_neighbor_similarity_mean, round(avg(a - b), 6) AS nearest_neighbor_margin_mean FROM f GROUP BY ALL")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sm.nearest_and_margin(_stats(spark, d)))


@_q("t10_j14_neighbour_agreement", _NUM + """, top AS (SELECT name, view, i, list(j) AS s FROM rk WHERE r <= 3 GROUP BY ALL),
pv AS (SELECT a.first, a.second, n.name, n.i, coalesce(x.s, []) AS x, coalesce(y.s, []) AS y FROM (VALUES ('title', 'organization'), ('title', 'coauthor'), ('organization', 'coauthor')) a(first, second) JOIN num n ON true
  LEFT JOIN top x ON x.name = n.name AND x.i = n.i AND x.view = a.first LEFT JOIN top y ON y.name = n.name AND y.i = n.i AND y.view = a.second)
SELECT name, first, second, round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS agreement FROM pv WHERE len(x) + len(y) > 0 GROUP BY ALL""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sm.neighbour_agreement(_stats(spark, d)))


_PAIRS = f"""
, kn AS (SELECT c.*, tru.label AS author FROM cards c JOIN tru USING (name, paper_id)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) - 1 AS i FROM kn),
doc AS (SELECT name, i, 't' AS f, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS terms FROM n2 UNION ALL SELECT name, i, 'a', regexp_extract_all(lower(substr(coalesce(abstract, ''), 1, 1200)), '[a-z0-9]+') FROM n2),
dn AS (SELECT name, count(*) AS n FROM n2 GROUP BY name),
dtf AS (SELECT name, f, i, t, count(*) AS tf FROM (SELECT name, f, i, unnest(terms) AS t FROM doc) GROUP BY ALL),
dw AS (SELECT name, f, i, t, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY name, f, t))) + 1) AS w FROM dtf JOIN dn USING (name)),
dv AS (SELECT name, f, i, t, w / sqrt(sum(w * w) OVER (PARTITION BY name, f, i)) AS w FROM dw),
ddot AS (SELECT a.name, a.f, a.i, b.i AS j, sum(a.w * b.w) AS s FROM dv a JOIN dv b ON a.name = b.name AND a.f = b.f AND a.t = b.t AND a.i < b.i GROUP BY ALL),
pf AS (SELECT name, i, paper_id, author, coalesce(trim(regexp_replace(lower(organization[1]), '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS org, {_COSET} AS co,
  trim(regexp_replace(lower(coalesce(title, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) <> '' AS ta, trim(regexp_replace(lower(substr(coalesce(abstract, ''), 1, 1200)), '[\\s\\p{{Z}}]+', ' ', 'g')) <> '' AS aa FROM n2),
po AS (SELECT *, list_distinct(regexp_extract_all(org, '[a-z0-9]+')) AS ot FROM pf),
pr AS (SELECT a.name AS author_block, a.paper_id AS paper_i, b.paper_id AS paper_j, a.author = b.author AS gt_same, a.ta AND b.ta AS title_available,
  CASE WHEN a.ta AND b.ta THEN least(1, coalesce(x.s, 0)) END AS tc, a.aa AND b.aa AS abstract_available, CASE WHEN a.aa AND b.aa THEN least(1, coalesce(y.s, 0)) END AS ac,
  a.org <> '' AND b.org <> '' AS organization_available, CASE WHEN a.org <> '' AND b.org <> '' THEN a.org = b.org END AS organization_exact_match,
  CASE WHEN len(a.ot) > 0 AND len(b.ot) > 0 THEN len(list_intersect(a.ot, b.ot)) / len(list_distinct(list_concat(a.ot, b.ot))) END AS oj, len(a.co) > 0 AS ci, len(b.co) > 0 AS cj,
  CASE WHEN len(a.co) > 0 AND len(b.co) > 0 THEN len(list_intersect(a.co, b.co)) END AS sc, CASE WHEN len(a.co) > 0 AND len(b.co) > 0 THEN len(list_intersect(a.co, b.co)) / len(list_distinct(list_concat(a.co, b.co))) END AS cjac
  FROM po a JOIN po b ON a.name = b.name AND a.i < b.i LEFT JOIN ddot x ON x.name = a.name AND x.f = 't' AND x.i = a.i AND x.j = b.i LEFT JOIN ddot y ON y.name = a.name AND y.f = 'a' AND y.i = a.i AND y.j = b.i)
"""


#: The same over the whole abstracts.
_WHOLE_PAIRS = _PAIRS.replace("substr(coalesce(abstract, ''), 1, 1200)", "coalesce(abstract, '')")


@_q("t07_j05_pair_records", _WHOLE_PAIRS + "SELECT author_block, paper_i, paper_j, gt_same, title_available, round(tc, 6) AS title_cosine_similarity, abstract_available, round(ac, 6) AS abstract_cosine_similarity, organization_available, organization_exact_match, round(oj, 6) AS organization_text_similarity, ci AS coauthor_available_i, cj AS coauthor_available_j, sc AS shared_coauthor_count, round(cjac, 6) AS coauthor_jaccard_similarity, sc > 0 AS coauthor_overlap_indicator FROM pr")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return sm.pair_records(tb.cards(spark, d), tb.truth(spark, d), digits=6)


@_q("a18_field_separation", _WHOLE_PAIRS + """, l AS (SELECT 'title' AS field, 'title_cosine_similarity' AS metric, gt_same, tc AS v FROM pr UNION ALL SELECT 'abstract', 'abstract_cosine_similarity', gt_same, ac FROM pr UNION ALL SELECT 'organization', 'organization_text_similarity', gt_same, oj FROM pr
UNION ALL SELECT 'coauthor_jaccard', 'coauthor_jaccard_similarity', gt_same, cjac FROM pr UNION ALL SELECT 'shared_coauthor_count', 'shared_coauthor_count', gt_same, sc FROM pr)
SELECT field, metric, count(v) AS available_pair_count, count(v) FILTER (gt_same) AS same_pair_count, count(v) FILTER (NOT gt_same) AS different_pair_count, round(avg(v) FILTER (gt_same), 6) AS same_mean, round(avg(v) FILTER (NOT gt_same), 6) AS different_mean,
  round(median(v) FILTER (gt_same), 6) AS same_median, round(median(v) FILTER (NOT gt_same), 6) AS different_median, round(avg(v) FILTER (gt_same) - avg(v) FILTER (NOT gt_same), 6) AS separation_gap FROM l WHERE v IS NOT NULL GROUP BY ALL""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sm.field_separation(tb.cards(spark, d), tb.truth(spark, d)))


@_q("w12_systematic_sample", _PAIRS + ", s AS (SELECT *, count(*) OVER (PARTITION BY author_block, gt_same) AS n, row_number() OVER (PARTITION BY author_block, gt_same ORDER BY paper_i, paper_j) - 1 AS r FROM pr) SELECT author_block, gt_same, paper_i, paper_j FROM s WHERE r % greatest(1, ceil(n / 120)) = 0 AND r / greatest(1, ceil(n / 120)) < 120")
def w12(spark: SparkSession, d: str) -> DataFrame:
    known = tb.cards(spark, d).select("name", "paper_id", "record_index").join(tb.truth(spark, d).select("name", "paper_id", F.col("label").alias("author")), ["name", "paper_id"])
    return an.sampled_pairs(sm.numbered(known), 120)


def _two(spark, d):
    full = lb.normalized_groups(tb.venue_clusters(spark, d), tb.blocks(spark, d), ["name"])
    without = lb.complete_labels(tb.blocks(spark, d), lb.assigned_label(tb.venue_clusters(spark, d), ["name"], "last"), ["name"])
    return without, full


_REP = """, wl AS (SELECT blk.name, blk.paper_id, coalesce(l.label, 'missing:' || blk.paper_id) AS label FROM blk LEFT JOIN vlast l USING (name, paper_id)),
l3 AS (SELECT t.name, t.paper_id, t.label AS t, w.label AS w, f.label AS f FROM tru t JOIN wl w USING (name, paper_id) JOIN vgroups f USING (name, paper_id)),
c3 AS (SELECT a.name, CASE WHEN (a.w = b.w) = (a.f = b.f) THEN 'unchanged' WHEN a.t = b.t AND a.w <> b.w THEN 'fs' WHEN a.t <> b.t AND a.w = b.w THEN 'fm' WHEN a.t = b.t THEN 'is' ELSE 'im' END AS c FROM l3 a JOIN l3 b ON a.name = b.name AND a.paper_id < b.paper_id),
rc AS (SELECT l3.name, coalesce(any_value(fs), 0) AS fixed_false_splits, coalesce(any_value(fm), 0) AS fixed_false_merges, coalesce(any_value(i_s), 0) AS introduced_false_splits, coalesce(any_value(im), 0) AS introduced_false_merges, coalesce(any_value(un), 0) AS unchanged_pairs
  FROM (SELECT DISTINCT name FROM l3) l3 LEFT JOIN (SELECT name, count(*) FILTER (c = 'fs') AS fs, count(*) FILTER (c = 'fm') AS fm, count(*) FILTER (c = 'is') AS i_s, count(*) FILTER (c = 'im') AS im, count(*) FILTER (c = 'unchanged') AS un FROM c3 GROUP BY name) USING (name) GROUP BY l3.name)
"""


@_q("a19_repair_counts", _REP + "SELECT *, fixed_false_splits + fixed_false_merges - introduced_false_splits - introduced_false_merges AS net_pairwise_gain FROM rc")
def a19(spark: SparkSession, d: str) -> DataFrame:
    without, full = _two(spark, d)
    return an.repair_counts(tb.truth(spark, d), without, full, ["name"])


_COUNTERS = ["fixed_false_splits", "fixed_false_merges", "introduced_false_splits", "introduced_false_merges", "unchanged_pairs"]


@_q("a17_total_rows", _REP + "SELECT 'venue' AS field_added, name AS author_block, " + ", ".join(_COUNTERS) + " FROM rc UNION ALL SELECT 'venue', 'ALL', " + ", ".join(f"sum({c})" for c in _COUNTERS) + " FROM rc HAVING count(*) > 0")
def a17(spark: SparkSession, d: str) -> DataFrame:
    without, full = _two(spark, d)
    r = an.repair_counts(tb.truth(spark, d), without, full, ["name"]).select(F.lit("venue").alias("field_added"), F.col("name").alias("author_block"), *_COUNTERS)
    return an.with_total_rows(r, _COUNTERS)


@_q("proj10_melted_counters", _REP + " SELECT name, counter, value FROM (SELECT name, fixed_false_splits, fixed_false_merges, introduced_false_splits, introduced_false_merges FROM rc) UNPIVOT (value FOR counter IN (fixed_false_splits, fixed_false_merges, introduced_false_splits, introduced_false_merges))")
def proj10(spark: SparkSession, d: str) -> DataFrame:
    without, full = _two(spark, d)
    return an.repair_counts(tb.truth(spark, d), without, full, ["name"]).unpivot("name", _COUNTERS[:4], "counter", "value")


@_q("j08_changed_pairs", _REP + ", ord AS (SELECT name, paper_id, record_index FROM blk) SELECT a.name AS author_block, a.paper_id AS paper_i, b.paper_id AS paper_j, CASE WHEN a.t = b.t AND a.w <> b.w THEN 'fixed_false_split' WHEN a.t <> b.t AND a.w = b.w THEN 'fixed_false_merge' WHEN a.t = b.t THEN 'introduced_false_split' ELSE 'introduced_false_merge' END AS change_type FROM l3 a JOIN ord oa USING (name, paper_id) JOIN l3 b ON a.name = b.name JOIN ord ob ON ob.name = b.name AND ob.paper_id = b.paper_id WHERE (oa.record_index, a.paper_id) < (ob.record_index, b.paper_id) AND (a.w = b.w) <> (a.f = b.f) AND a.paper_id IN (SELECT id FROM pap) AND b.paper_id IN (SELECT id FROM pap)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return an.changed_pairs(known_papers(spark, d), *_two(spark, d))


def known_papers(spark: SparkSession, d: str) -> DataFrame:
    """(name, paper_id, record_index, author, i): the papers of the store with a known author, numbered within their block."""
    return sm.numbered(tb.cards(spark, d).select("name", "paper_id", "record_index").join(tb.truth(spark, d).withColumnRenamed("label", "author"), ["name", "paper_id"]))


@_q("t14_coauthor_components", """, e AS (SELECT name, record_index, paper_id, unnest(list_distinct(list_filter(list_transform(coauthors, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> ''))) AS t FROM cards),
r AS (WITH RECURSIVE g AS (SELECT name, paper_id, record_index AS c FROM cards UNION SELECT b.name, b.paper_id, g.c FROM g JOIN e a ON a.name = g.name AND a.paper_id = g.paper_id JOIN e b ON b.name = a.name AND b.t = a.t WHERE g.c < b.record_index) SELECT * FROM g)
SELECT name, paper_id, min(c) AS component FROM r GROUP BY ALL""")
def t14(spark: SparkSession, d: str) -> DataFrame:
    c = tb.cards(spark, d).select("name", "paper_id", "record_index", alnum_coauthor_set().alias("co"))
    edges = c.select("name", F.col("record_index").alias("i"), F.explode("co").alias("token"))
    comp = graph.bipartite_components(edges, c.select("name", F.col("record_index").alias("i")), ["name"])
    return c.join(comp.withColumnRenamed("i", "record_index"), ["name", "record_index"]).select("name", "paper_id", "component")


@_q("j06_shared_tokens", ", s AS (SELECT name, paper_id, unnest(list_distinct(list_filter(list_transform(coauthors, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> ''))) AS t FROM cards) SELECT a.name, a.paper_id AS paper_i, b.paper_id AS paper_j, count(*) AS shared FROM s a JOIN s b ON a.name = b.name AND a.t = b.t AND a.paper_id < b.paper_id GROUP BY ALL")
def j06(spark: SparkSession, d: str) -> DataFrame:
    s = tb.cards(spark, d).select("name", "paper_id", F.explode(alnum_coauthor_set()).alias("t"))
    return sm.shared_tokens(s)
