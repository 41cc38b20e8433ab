"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwise.common import read_table
from blockwise.llm import consistent, distinctive, leakage, names, packing, pairs, quality, set_pairs, splitting

PAPER_TEXT = ["title", "abstract", "keywords"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(read_table(spark, d, "cluster_requests"), read_table(spark, d, "model_limits"))
    return pieces.where("n_pieces > 1").select("request_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, d, "cluster_requests"), read_table(spark, d, "model_limits"))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of every prompt: all within the limit, and together the whole prompt without a gap."""
    pieces = p1_pieces(spark, d).join(read_table(spark, d, "model_limits").select("model", "prompt_limit").distinct(), "model")
    order = Window.partitionBy("request_id", "model").orderBy("piece_no")
    step = pieces.select("request_id", "model", "end", "start", (F.col("n_tokens") <= F.col("prompt_limit")).alias("fits"), F.lag("end", 1, 0).over(order).alias("before"))
    return step.groupBy("request_id", "model").agg(F.max("end").alias("n_chars"), F.every("fits").alias("within_limit"), F.every(F.col("start") <= F.col("before")).alias("without_gap"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    people = names.person_pairs(read_table(spark, d, "author_entries").where("not is_target"))
    orgs = names.org_pairs(read_table(spark, d, "org_register"))
    return people.select(F.lit("person").alias("kind"), "id_a", "id_b").unionByName(orgs.select(F.lit("org").alias("kind"), "id_a", "id_b"))


def p3_people(spark: SparkSession, d: str) -> DataFrame:
    """One row per entry with its class and the number of other entries linked to it."""
    links = names.person_links(read_table(spark, d, "author_entries").where("not is_target"))
    size = links.groupBy("person_id").agg(F.count(F.lit(1)).alias("entries"))
    return links.join(size, "person_id").select("entry_id", "person_id", (F.col("entries") - 1).alias("n_links"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(read_table(spark, d, "sna_valid_pub"), PAPER_TEXT)


def p4_rounded(spark: SparkSession, d: str) -> DataFrame:
    """All scores, rounded so that sums of logs taken in another order agree."""
    return p4_scores(spark, d).select("paper_id", "term", "tf", "n_terms", "df", "cf", F.round("score", 2).alias("score"), F.round("score_fdr", 2).alias("score_fdr"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # the adjusted score needs the scores of all terms of a paper, so the operator runs in full
    return p4_scores(spark, d).where("df between 2 and 5 and score_fdr >= 0").select("paper_id", "term")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, classes = set_pairs.similar_sets(read_table(spark, d, "paper_cards"), "card_id", ["coauthors", "organization"])
    return set_pairs.expand_pairs(members, classes)


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per card of four or more elements: its class of equal sets and the number of similar classes."""
    members, classes = set_pairs.similar_sets(read_table(spark, d, "paper_cards"), "card_id", ["coauthors", "organization"])
    both = classes.select(F.col("class_a").alias("class_id")).unionByName(classes.select(F.col("class_b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(both, "class_id", "left").select(F.col("id").alias("card_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(read_table(spark, d, "cluster_responses"), read_table(spark, d, "cluster_requests"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent.disguised(read_table(spark, d, "author_entries"), "entry_id", ["name", "org"])


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent.consistent_form(read_table(spark, d, "author_entries").select("entry_id", "name", "org"), ["name", "org"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(read_table(spark, d, "documents"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every document with a text: all its tokens are placed once, in containers that are not overfull."""
    placed = p8_containers(spark, d)
    fill = placed.groupBy("container_id").agg((F.sum("n_tokens") <= 2048).alias("fits"))
    per = placed.join(fill, "container_id").groupBy("doc_id").agg(F.every("fits").alias("within_capacity"), (F.sum("n_tokens") == F.max("token_end")).alias("whole"), F.countDistinct("piece_no").alias("a"), F.count(F.lit(1)).alias("b"))
    return per.select("doc_id", "within_capacity", (F.col("whole") & (F.col("a") == F.col("b"))).alias("placed_once"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return leakage.decontaminate(docs, leakage.leaked_passages(docs, read_table(spark, d, "eval_items"))).select("doc_id", "source", "n_chars")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(read_table(spark, d, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(read_table(spark, d, "documents"))


def p10_tails(spark: SparkSession, d: str) -> DataFrame:
    """The exact rank tails of the operator for one statistic that SQL can state as well, the length of the text."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim(F.lower("lang")), F.lit("")), F.lit("und")).alias("lang"), F.length("text").alias("n_chars"))
    long, table = quality.rank_tails(docs, ["n_chars"])
    r6 = lambda c: F.round(c, 6).alias(c)
    return long.join(table, ["stat", "lang", "value"]).select("doc_id", F.col("value").cast("long").alias("n_chars"), r6("low"), r6("high"), r6("low_all"), r6("high_all"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_limits, p3_found, p3_people, p4_found, p4_scores, p4_rounded, p5_found, p5_links, p6_found, p7_found, p7_forms, p8_containers, p8_items, p9_found, p9_clean, p10_found, p10_report, p10_tails)}

SQL = {
    "p10_tails": """
WITH d AS (SELECT doc_id, coalesce(nullif(trim(lower(lang)), ''), 'und') AS lang, length(text) AS n_chars FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n_chars, round(cume_dist() OVER (PARTITION BY lang ORDER BY n_chars), 6) AS low, round(cume_dist() OVER (PARTITION BY lang ORDER BY n_chars DESC), 6) AS high,
  round(cume_dist() OVER (ORDER BY n_chars), 6) AS low_all, round(cume_dist() OVER (ORDER BY n_chars DESC), 6) AS high_all FROM d""",
    "p1_found": """
SELECT DISTINCT r.request_id FROM cluster_requests r JOIN model_limits m ON r.model = m.model
WHERE length(r.prompt) // 4 > m.prompt_limit""",
    "p4_found": """
WITH latest AS (
  SELECT id, lower(concat_ws(' | ', title, abstract, keywords)) AS body FROM sna_valid_pub
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, abstract DESC NULLS LAST, keywords DESC NULLS LAST) = 1),
terms AS (SELECT DISTINCT id AS paper_id, unnest(regexp_extract_all(body, '[a-z]+')) AS term FROM latest WHERE id IS NOT NULL)
SELECT paper_id, term FROM terms WHERE length(term) >= 4
QUALIFY count(*) OVER (PARTITION BY term) BETWEEN 2 AND 5""",
    "p5_found": """
WITH el AS (
  SELECT DISTINCT card_id, trim(regexp_replace(lower(e), '\\s+', ' ', 'g')) AS e
  FROM (SELECT card_id, unnest(list_concat(coalesce(coauthors, []), coalesce(organization, []))) AS e FROM paper_cards) WHERE e IS NOT NULL),
s AS (SELECT card_id, e FROM el WHERE e <> '' QUALIFY count(*) OVER (PARTITION BY card_id) >= 4),
n AS (SELECT card_id, count(*) AS n FROM s GROUP BY card_id),
c AS (SELECT a.card_id AS card_a, b.card_id AS card_b, count(*) AS x FROM s a JOIN s b ON a.e = b.e AND a.card_id < b.card_id GROUP BY ALL)
SELECT card_a, card_b FROM c JOIN n na ON na.card_id = card_a JOIN n nb ON nb.card_id = card_b WHERE x >= 0.6 * (na.n + nb.n - x)""",
    "p9_found": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}

SQL |= {
    "p1_limits": """
SELECT DISTINCT r.request_id, r.model, length(r.prompt) AS n_chars, true AS within_limit, true AS without_gap FROM cluster_requests r JOIN model_limits m ON r.model = m.model WHERE r.prompt IS NOT NULL""",
    "p4_rounded": """
WITH latest AS (
  SELECT id, lower(concat_ws(' | ', title, abstract, keywords)) AS body FROM sna_valid_pub
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, abstract DESC NULLS LAST, keywords DESC NULLS LAST) = 1),
tok AS (SELECT id AS paper_id, unnest(list_filter(regexp_extract_all(body, '[a-z]+'), lambda t: length(t) >= 4)) AS term FROM latest WHERE id IS NOT NULL),
tf AS (SELECT paper_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT *, sum(tf) OVER (PARTITION BY paper_id) AS n, count(*) OVER (PARTITION BY term) AS df, sum(tf) OVER (PARTITION BY term) AS m, sum(tf) OVER () AS t FROM tf),
few AS (SELECT DISTINCT tf, n, m, t FROM st),
lc AS (SELECT *, list_sum(list_transform(range(tf, least(n, m)::BIGINT + 1), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(t - m + 1) - lgamma(n - j + 1) - lgamma(t - m - n + j + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)))) AS p FROM few),
sc AS (SELECT paper_id, term, st.tf, st.n, df, st.m, greatest(0, -ln(p)) AS s FROM st JOIN lc ON lc.tf = st.tf AND lc.n = st.n AND lc.m = st.m),
ad AS (SELECT *, s - ln(count(*) OVER (PARTITION BY paper_id) / row_number() OVER (PARTITION BY paper_id ORDER BY s DESC, term)) AS a FROM sc)
SELECT paper_id, term, tf, n::BIGINT AS n_terms, df, m::BIGINT AS cf, round(s, 2) AS score, round(greatest(0, max(a) OVER (PARTITION BY paper_id ORDER BY s, term DESC ROWS UNBOUNDED PRECEDING)), 2) AS score_fdr FROM ad""",
    "p5_links": """
WITH el AS (
  SELECT DISTINCT card_id, trim(regexp_replace(lower(e), '\\s+', ' ', 'g')) AS e
  FROM (SELECT card_id, unnest(list_concat(coalesce(coauthors, []), coalesce(organization, []))) AS e FROM paper_cards) WHERE e IS NOT NULL),
s AS (SELECT card_id, list_sort(list(e)) AS l FROM el WHERE e <> '' GROUP BY card_id HAVING count(*) >= 4),
k AS (SELECT l, min(card_id) AS class_id FROM s GROUP BY l),
x AS (SELECT class_id, unnest(l) AS e, len(l) AS n FROM k),
c AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x FROM x a JOIN x b ON a.e = b.e AND a.class_id <> b.class_id GROUP BY ALL),
g AS (SELECT a, count(*) AS n_links FROM c WHERE x >= 0.6 * (na + nb - x) GROUP BY a)
SELECT s.card_id, k.class_id, coalesce(n_links, 0) AS n_links FROM s JOIN k ON s.l = k.l LEFT JOIN g ON g.a = k.class_id""",
    "p8_items": "SELECT DISTINCT doc_id, true AS within_capacity, true AS placed_once FROM documents WHERE text <> ''",
    "p9_clean": f"SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SQL['p9_found']}) f)",
}
