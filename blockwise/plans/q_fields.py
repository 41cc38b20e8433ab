"""Queries of projections, filters and set operations over blocks and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import read_table
from blockwise.functions import fields as fl
from blockwise.functions import text as tx
from blockwise.operators import selection
from blockwise.plans.sql_base import sql
from blockwise.sources import tables as tb

QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


_KEYS = "SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name_key, array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), '') AS forward, array_to_string(list_reverse(regexp_extract_all(lower(name), '[a-z0-9]+')), '') AS backward, trim(regexp_replace(lower(name), '[\\s\\p{Z}]+', ' ', 'g')) AS clean FROM (SELECT DISTINCT name FROM author_entries WHERE name IS NOT NULL)"


@_q("proj14_15_16_name_keys", _KEYS)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "author_entries").where("name is not null").select("name").distinct()
    w = tx.tokens("name")
    return n.select("name", tx.alnum_key("name").alias("name_key"), F.array_join(w, "").alias("forward"), F.array_join(F.reverse(w), "").alias("backward"), tx.clean_text("name").alias("clean"))


@_q("j01_block_papers", sql("SELECT name, paper_id, record_index, title FROM blk JOIN pap ON blk.paper_id = pap.id"))
def j01(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).join(tb.papers(spark, d).withColumnRenamed("id", "paper_id"), "paper_id").select("name", "paper_id", "record_index", "title")


@_q("j01_unknown_papers", sql("SELECT name, paper_id, record_index FROM blk WHERE paper_id NOT IN (SELECT id FROM pap)"))
def j01_unknown(spark: SparkSession, d: str) -> DataFrame:
    return fl.unknown_papers(tb.blocks(spark, d), tb.papers(spark, d)).select("name", "paper_id", "record_index")


@_q("proj01_target_fields", sql("SELECT name, paper_id, array_to_string(organization, '|') AS organization, array_to_string(coauthors, '|') AS coauthors FROM cards"))
def p01(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", F.array_join("organization", "|").alias("organization"), F.array_join("coauthors", "|").alias("coauthors"))


@_q("proj02_cards", sql("SELECT name, paper_id, concat_ws(' / ', paper_id, title, venue, year) AS card FROM cards"))
def p02(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", F.concat_ws(" / ", *[fl.card(["title", "venue", "year"])[c] for c in ("paper_id", "title", "venue", "year")]).alias("card"))


@_q("proj03_display_ids", sql("SELECT name, paper_id, (row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) - 1) AS record_index, 'P' || row_number() OVER (PARTITION BY name ORDER BY record_index, paper_id) AS display_id FROM cards"))
def p03(spark: SparkSession, d: str) -> DataFrame:
    return fl.indexed_cards(tb.cards(spark, d), ["title"]).select("name", "paper_id", "record_index", "display_id")


_CLEAN = "trim(regexp_replace(lower({}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_COSET = "list_distinct(list_filter(list_transform(coauthors, lambda x: " + _CLEAN.format("x") + "), lambda x: x <> '' AND x <> " + _CLEAN.format("name") + "))"


@_q("proj04_coauthor_sets", sql(f"SELECT name, paper_id, array_to_string(list_sort({_COSET}), '|') AS coauthor_set FROM cards"))
def p04(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", F.array_join(F.array_sort(fl.coauthor_set()), "|").alias("coauthor_set"))


@_q("proj05_alnum_coauthor_sets", sql("SELECT name, paper_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coauthors, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> ''))), '|') AS coauthor_keys FROM cards"))
def p05(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", F.array_join(F.array_sort(fl.alnum_coauthor_set()), "|").alias("coauthor_keys"))


@_q("proj06_organization_tokens", sql("SELECT name, paper_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(array_to_string(organization, ' ')), '[a-z0-9]+'))), ' ') AS org_tokens FROM cards"))
def p06(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", F.array_join(F.array_sort(fl.organization_tokens()), " ").alias("org_tokens"))


@_q("proj07_target_org", sql("SELECT name, paper_id, coalesce(" + _CLEAN.format("organization[1]") + ", '') AS org FROM cards"))
def p07(spark: SparkSession, d: str) -> DataFrame:
    return tb.cards(spark, d).select("name", "paper_id", fl.target_org().alias("org"))


@_q("proj08_paper_features", sql(f"SELECT name, paper_id, substr(coalesce(abstract, ''), 1, 1200) AS abstract_vector, substr(coalesce(abstract, ''), 1, 350) AS abstract_display, {_CLEAN.format(chr(99)+'oalesce(title, '+chr(39)*2+')')} <> '' AS title_available, {_CLEAN.format(chr(99)+'oalesce(abstract, '+chr(39)*2+')')} <> '' AS abstract_available, coalesce({_CLEAN.format('organization[1]')}, '') <> '' AS organization_available, len({_COSET}) > 0 AS coauthor_available FROM cards"))
def p08(spark: SparkSession, d: str) -> DataFrame:
    return fl.paper_features(tb.cards(spark, d)).select("name", "paper_id", "abstract_vector", "abstract_display", "title_available", "abstract_available", "organization_available", "coauthor_available")


@_q("proj09_true_author", sql("SELECT blk.name, paper_id, tru.label AS author_id FROM blk LEFT JOIN tru USING (name, paper_id)"))
def p09(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).join(tb.truth(spark, d), ["name", "paper_id"], "left").select("name", "paper_id", F.col("label").alias("author_id"))


@_q("proj10a_unpivot_sizes", "WITH s AS (SELECT name, count(*) AS n_rows, count(paper_count) AS stated, count(DISTINCT paper_id) AS papers FROM sna_valid_raw GROUP BY name) SELECT name, 'n_rows' AS counter, n_rows AS value FROM s UNION ALL SELECT name, 'stated', stated FROM s UNION ALL SELECT name, 'papers', papers FROM s")
def p10a(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sna_valid_raw").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("paper_count").alias("stated"), F.countDistinct("paper_id").alias("papers"))
    return s.unpivot("name", ["n_rows", "stated", "papers"], "counter", "value")


@_q("proj11_ordered_category", "SELECT request_id, task, model, list_position(['halden-small', 'halden-base', 'orrin-chat', 'orrin-long', 'tessel-mini', 'tessel-1'], model) AS sort_key FROM (SELECT DISTINCT request_id, task, model FROM cluster_requests)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    order = ["halden-small", "halden-base", "orrin-chat", "orrin-long", "tessel-mini", "tessel-1"]
    return read_table(spark, d, "cluster_requests").select("request_id", "task", "model").distinct().withColumn("sort_key", selection.category_key(F.col("model"), order))


@_q("proj12_field_combinations", "WITH f AS (SELECT unnest(['title', 'abstract', 'keywords', 'organization', 'coauthors', 'venue', 'year']) AS f, unnest(range(7)) AS i) SELECT a.f || '+' || b.f || '+' || c.f AS combination, 3 AS n_fields FROM f a JOIN f b ON a.i < b.i JOIN f c ON b.i < c.i")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return fl.field_combinations(spark, 3)


@_q("j15_names_by_field", sql("SELECT name, f AS field FROM (SELECT DISTINCT name FROM blk), (SELECT unnest(['title', 'abstract', 'keywords', 'organization', 'coauthors', 'venue', 'year']) AS f)"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    return selection.sweep(tb.blocks(spark, d).select("name").distinct(), field=fl.FIELDS)


@_q("a12_coverage_mart", sql("SELECT name, paper_count, round(coalesce(t, 0) / paper_count, 6) AS title_coverage, round(coalesce(o, 0) / paper_count, 6) AS organization_coverage, round(coalesce(c, 0) / paper_count, 6) AS coauthor_coverage FROM (SELECT name, count(*) AS paper_count FROM blk GROUP BY name) LEFT JOIN (SELECT name, sum((coalesce(length(title), 0) > 0)::INT) AS t, sum((len(list_filter(organization, lambda x: x <> '')) > 0)::INT) AS o, sum((len(coauthors) > 0)::INT) AS c FROM cards GROUP BY name) USING (name)"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fl.coverage(tb.cards(spark, d), tb.blocks(spark, d)).drop("overall_coverage"))


@_q("a12_coverage_router", sql(f"SELECT name, paper_count, round(coalesce(t, 0) / paper_count, 6) AS title_coverage, round(coalesce(o, 0) / paper_count, 6) AS organization_coverage, round(coalesce(c, 0) / paper_count, 6) AS coauthor_coverage, round((coalesce(t, 0) + coalesce(o, 0) + coalesce(c, 0)) / paper_count / 3, 6) AS overall_coverage FROM (SELECT name, count(*) AS paper_count FROM blk GROUP BY name) LEFT JOIN (SELECT name, sum((coalesce({_CLEAN.format('title')}, '') <> '')::INT) AS t, sum((len(regexp_extract_all(lower(array_to_string(organization, ' ')), '[a-z0-9]+')) > 0)::INT) AS o, sum((len({_COSET}) > 0)::INT) AS c FROM cards GROUP BY name) USING (name)"))
def a12r(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fl.coverage(tb.cards(spark, d), tb.blocks(spark, d), "router"))


@_q("a12_coverage_dry_run", sql("SELECT name, paper_count, round(coalesce(o, 0) / paper_count, 6) AS organization_coverage FROM (SELECT name, count(*) AS paper_count FROM blk GROUP BY name) LEFT JOIN (SELECT name, sum((len(organization) > 0)::INT) AS o FROM cards GROUP BY name) USING (name)"))
def a12d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fl.coverage(tb.cards(spark, d), tb.blocks(spark, d), "dry_run").select("name", "paper_count", "organization_coverage"))


@_q("f01_completed", "SELECT DISTINCT response_id FROM cluster_responses WHERE finish_reason IN ('stop', 'end_turn') AND content IS NOT NULL")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return selection.completed(read_table(spark, d, "cluster_responses")).select("response_id").distinct()


@_q("f02_selected_names", "SELECT name, count(*) AS n FROM sna_valid_raw WHERE name IN (SELECT min(name) FROM sna_valid_raw UNION SELECT max(name) FROM sna_valid_raw) GROUP BY name")
def f02(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "sna_valid_raw")
    ends = raw.agg(F.min("name").alias("a"), F.max("name").alias("b")).first()
    return selection.select_names(raw, sorted({ends["a"], ends["b"]} - {None})).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@_q("f06_prompt_budget", "SELECT request_id, length(prompt) // 4 AS tokens, (length(prompt) // 4) <= prompt_limit AS within_limit, (length(prompt) // 4) <= 18000 AS feasible FROM (SELECT DISTINCT request_id, model, prompt FROM cluster_requests) JOIN model_limits USING (model)")
def f06(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "cluster_requests").select("request_id", "model", "prompt").distinct()
    return selection.prompt_budget(q, read_table(spark, d, "model_limits")).select("request_id", "tokens", "within_limit", "feasible")


@_q("f10_resume", "SELECT DISTINCT request_id FROM cluster_requests WHERE request_id NOT IN (SELECT request_id FROM cluster_responses WHERE request_id IS NOT NULL)")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return selection.to_do(read_table(spark, d, "cluster_requests").select("request_id").distinct(), read_table(spark, d, "cluster_responses"), ["request_id"])


@_q("j03_status", "SELECT q.request_id, CASE WHEN count(r.response_id) = 0 THEN 'not_run' WHEN count_if(r.finish_reason IN ('stop', 'end_turn') AND r.content IS NOT NULL) > 0 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT DISTINCT request_id FROM cluster_requests) q LEFT JOIN cluster_responses r ON q.request_id = r.request_id GROUP BY q.request_id")
def j03(spark: SparkSession, d: str) -> DataFrame:
    return selection.run_status(read_table(spark, d, "cluster_requests").select("request_id").distinct(), read_table(spark, d, "cluster_responses"))


@_q("a24_status_counts", "SELECT name, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'not_run') AS not_run FROM (SELECT q.name, q.request_id, CASE WHEN count(r.response_id) = 0 THEN 'not_run' WHEN count_if(r.finish_reason IN ('stop', 'end_turn') AND r.content IS NOT NULL) > 0 THEN 'completed' ELSE 'failed' END AS status FROM (SELECT DISTINCT name, request_id FROM cluster_requests) q LEFT JOIN cluster_responses r ON q.request_id = r.request_id GROUP BY ALL) GROUP BY name")
def a24(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "cluster_requests").select("name", "request_id").distinct()
    s = selection.run_status(q.select("request_id"), read_table(spark, d, "cluster_responses"))
    return q.join(s, "request_id").groupBy("name").agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("completed", "failed", "not_run")])


@_q("u01_intersect", sql("SELECT name FROM blk INTERSECT SELECT name FROM cluster_requests"))
def u01(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).select("name").intersect(read_table(spark, d, "cluster_requests").select("name"))


@_q("u02_except", sql("SELECT name, paper_id FROM blk EXCEPT SELECT name, paper_id FROM tru"))
def u02(spark: SparkSession, d: str) -> DataFrame:
    return tb.blocks(spark, d).select("name", "paper_id").join(tb.truth(spark, d), ["name", "paper_id"], "left_anti")


@_q("u03_union", "SELECT paper_id FROM sna_valid_labels UNION SELECT paper_id FROM sna_valid_raw")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sna_valid_labels").select("paper_id").union(read_table(spark, d, "sna_valid_raw").select("paper_id")).distinct()


@_q("u05_union_all_nullable", "SELECT name, paper_id, NULL AS author_id FROM sna_valid_raw UNION ALL SELECT name, paper_id, author_id FROM sna_valid_labels")
def u05(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sna_valid_raw").select("name", "paper_id").unionByName(read_table(spark, d, "sna_valid_labels").select("name", "paper_id", "author_id"), allowMissingColumns=True)


@_q("u06_set_equality", sql("SELECT name, (SELECT count(*) FROM (SELECT paper_id FROM blk b WHERE b.name = n.name EXCEPT SELECT paper_id FROM tru t WHERE t.name = n.name)) = 0 AND (SELECT count(*) FROM (SELECT paper_id FROM tru t WHERE t.name = n.name EXCEPT SELECT paper_id FROM blk b WHERE b.name = n.name)) = 0 AS same FROM (SELECT DISTINCT name FROM blk) n"))
def u06(spark: SparkSession, d: str) -> DataFrame:
    return selection.same_sets(tb.blocks(spark, d), tb.truth(spark, d), ["name"], "paper_id")


@_q("w07_chronological", sql("SELECT name, paper_id, row_number() OVER (PARTITION BY name ORDER BY try_cast(CASE WHEN regexp_full_match(trim(year), '[+-]?[0-9]+') THEN trim(year) END AS INT) NULLS LAST, paper_id) AS place FROM cards"))
def w07(spark: SparkSession, d: str) -> DataFrame:
    return selection.chronological(tb.cards(spark, d)).select("name", "paper_id", "place")


@_q("t15_organization_groups", sql("SELECT name, paper_id, dense_rank() OVER (PARTITION BY name ORDER BY k) AS group_no FROM (SELECT name, paper_id, coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(array_to_string(organization, ' ')), '[a-z0-9]+'))), ' '), ''), '__missing_organization__') AS k FROM cards)"))
def t15(spark: SparkSession, d: str) -> DataFrame:
    return selection.organization_groups(tb.cards(spark, d)).select("name", "paper_id", "group_no")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
