"""Common table expressions of the SQL forms: the same frames as ``blockwise.sources.tables`` over the raw tables."""

BASE = r"""
blk AS (SELECT name, paper_id, min(record_index) AS record_index FROM sna_valid_raw WHERE name IS NOT NULL AND paper_id IS NOT NULL GROUP BY ALL),
pap AS (SELECT id, title, abstract, keywords, venue, year, authors FROM sna_valid_pub WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, abstract DESC NULLS LAST, keywords DESC NULLS LAST, venue DESC NULLS LAST, year DESC NULLS LAST) = 1),
tru AS (SELECT name, paper_id, min(author_id) AS label FROM sna_valid_labels l SEMI JOIN blk USING (name, paper_id) WHERE author_id IS NOT NULL GROUP BY ALL),
keyed AS (
  SELECT name, paper_id, record_index, title, abstract, keywords, venue, year, coalesce(authors, []) AS authors,
    [array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ''), array_to_string(list_reverse(regexp_extract_all(lower(name), '[a-z0-9]+')), '')] AS forms
  FROM blk JOIN pap ON blk.paper_id = pap.id),
marked AS (
  SELECT *, list_transform(authors, lambda a: {'name': coalesce(a.name, ''), 'org': coalesce(a.org, ''),
      'own': list_contains(forms, regexp_replace(lower(coalesce(a.name, '')), '[^a-z0-9]', '', 'g')) AND regexp_replace(lower(coalesce(a.name, '')), '[^a-z0-9]', '', 'g') <> ''}) AS au
  FROM keyed),
cards AS (
  SELECT name, paper_id, record_index, title, abstract, keywords, venue, year,
    list_transform(list_filter(au, lambda a: a.own), lambda a: a.org) AS organization, list_transform(list_filter(au, lambda a: NOT a.own), lambda a: a.name) AS coauthors
  FROM marked),
req AS (SELECT DISTINCT request_id, name, first_index, paper_count FROM cluster_requests WHERE task = 'assign' AND request_id IS NOT NULL),
uni AS (
  SELECT s.response_id, s.name, blk.paper_id
  FROM (SELECT response_id, name, unnest(range(first_index, first_index + paper_count)) AS record_index
        FROM (SELECT DISTINCT response_id, request_id FROM cluster_responses WHERE response_id IS NOT NULL) JOIN req USING (request_id) WHERE paper_count > 0) s
  JOIN blk ON blk.name = s.name AND blk.record_index = s.record_index),
asg AS (
  SELECT response_id, name, first_index, try_cast(e.key AS INT) AS k, e.value AS c
  FROM (SELECT response_id, request_id, unnest(m) AS e FROM (SELECT DISTINCT response_id, request_id, map_entries(assignments) AS m FROM cluster_responses WHERE response_id IS NOT NULL AND assignments IS NOT NULL)) x JOIN req USING (request_id)
  WHERE try_cast(e.key AS INT) >= 0),
rcl AS (
  SELECT a.response_id, a.name, min(a.k) OVER (PARTITION BY a.response_id, a.c) AS cluster_index, a.k AS pos, coalesce(blk.paper_id, '#' || (a.first_index + a.k)) AS paper_id
  FROM asg a LEFT JOIN blk ON blk.name = a.name AND blk.record_index = a.first_index + a.k),
vrows AS (
  SELECT name, paper_id, record_index, 'v:' || trim(venue) AS label FROM cards WHERE trim(coalesce(venue, '')) <> ''
  UNION ALL SELECT name, paper_id, record_index, 'y:' || trim(year) FROM cards WHERE coalesce(keywords, '') <> '' AND trim(coalesce(year, '')) <> ''),
vnum AS (SELECT name, label, row_number() OVER (PARTITION BY name ORDER BY min(record_index), label) - 1 AS cluster_index FROM vrows GROUP BY name, label),
vcl AS (SELECT name, cluster_index, label, record_index AS pos, paper_id FROM vrows JOIN vnum USING (name, label)),
vlab AS (SELECT name, paper_id, coalesce(nullif(trim(venue), ''), 'missing:' || paper_id) AS label FROM cards),
vfirst AS (SELECT name, paper_id, arg_min(cluster_index, (cluster_index, pos))::VARCHAR AS label FROM vcl GROUP BY ALL),
vlast AS (SELECT name, paper_id, arg_max(cluster_index, (cluster_index, pos))::VARCHAR AS label FROM vcl GROUP BY ALL),
vgroups AS (SELECT blk.name, blk.paper_id, coalesce(f.label, 'missing:' || blk.paper_id) AS label FROM blk LEFT JOIN vfirst f USING (name, paper_id)),
cell AS (SELECT t.name, t.label AS t, p.label AS p, count(*) AS n FROM tru t JOIN vgroups p USING (name, paper_id) GROUP BY ALL),
cells AS (SELECT *, sum(n) OVER (PARTITION BY name, t) AS ts, sum(n) OVER (PARTITION BY name, p) AS ps FROM cell),
pw AS (
  SELECT name, papers, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS rc
  FROM (SELECT name, sum(n) AS papers, sum(n * (n - 1) / 2) AS tp, sum(n * (ts - 1) / 2) AS tt, sum(n * (ps - 1) / 2) AS pp FROM cells GROUP BY name)),
b3 AS (SELECT name, sum(n * n / ps) / sum(n) AS pr, sum(n * n / ts) / sum(n) AS rc FROM cells GROUP BY name),
best AS (SELECT t.name, t.label AS author, v.cluster_index, count(DISTINCT t.paper_id) AS n FROM tru t JOIN vcl v USING (name, paper_id) GROUP BY ALL),
acov AS (
  SELECT a.name, a.author, a.papers, coalesce(b.best, 0) AS best
  FROM (SELECT name, label AS author, count(*) AS papers FROM tru GROUP BY ALL) a LEFT JOIN (SELECT name, author, max(n) AS best FROM best GROUP BY ALL) b USING (name, author)),
viol AS (
  SELECT coalesce(u.response_id, c.response_id) AS response_id, coalesce(u.name, c.name) AS name, u.paper_id IS NOT NULL AS expected, coalesce(u.paper_id, c.paper_id) AS paper_id, c.clusters, c.rows
  FROM uni u FULL JOIN (SELECT response_id, name, paper_id, count(DISTINCT cluster_index) AS clusters, count(*) AS rows FROM rcl GROUP BY ALL) c ON u.response_id = c.response_id AND u.name = c.name AND u.paper_id = c.paper_id)
"""


def sql(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body.strip()
