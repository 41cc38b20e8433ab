"""Normalisation, fields, responses, selection and orders on small fixtures."""

import pytest
from pyspark.sql import functions as F

from blockwise.common import join_by_weight, weighted_rank
from blockwise.functions import fields, text
from blockwise.operators import graph, prompts, responses, selection, similarity


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr("s")).first()[0]


@pytest.mark.parametrize("value, key, forms, clean, title", [
    ("Wei  Zhang", "weizhang", ["weizhang", "zhangwei"], "wei zhang", ["wei", "zhang"]),
    (" É. Müller ", "mller", ["mller", "llerm"], "é. müller", []),
    ("李明", "", [""], "李明", []),
    (None, "", [""], "", []),
    ("a b​naïve x_y", "abnavexy", None, "a b​naïve x_y", ["a", "b"]),
])
def test_kernel(spark, value, key, forms, clean, title):
    assert one(spark, value, text.alnum_key) == key
    if forms is not None:
        assert sorted(one(spark, value, text.name_forms)) == sorted(forms)
    assert one(spark, value, text.clean_text) == clean
    assert one(spark, value, text.title_tokens) == title


def test_target_fields_and_coverage(spark):
    rows = [("wei zhang", "p1", 0, "T", [("Wei Zhang", "X"), ("Zhang Wei", None), ("李明", "Y"), (None, "Z")]), ("wei zhang", "p2", 1, None, None), ("wei zhang", "p3", 2, " ", [("Wei Zhang", "")])]
    df = spark.createDataFrame(rows, "name string, paper_id string, record_index int, title string, authors array<struct<name:string,org:string>>")
    c = {r.paper_id: r for r in fields.with_target_fields(df).collect()}
    assert c["p1"].organization == ["X", ""] and c["p1"].coauthors == ["李明", ""]
    assert c["p2"].organization == [] and c["p2"].coauthors == []
    cards, blocks = fields.with_target_fields(df), df.select("name", "paper_id").union(spark.createDataFrame([("wei zhang", "p9")], "name string, paper_id string"))
    mart = fields.coverage(cards, blocks).first()
    assert (mart.title_coverage, mart.organization_coverage, mart.coauthor_coverage) == (0.5, 0.25, 0.25)
    assert fields.coverage(cards, blocks, "router").first().title_coverage == 0.25
    assert fields.coverage(cards, blocks, "dry_run").first().organization_coverage == 0.5
    with pytest.raises(ValueError):
        fields.parse_combination("title+title")
    with pytest.raises(ValueError):
        fields.parse_combination("title+nothing")


@pytest.mark.parametrize("content, status", [
    ('{"assignments":{"0":"a"}}', "ok"), ('```json\n{"clusters":[["p1"],{"label":"x","paper_ids":["p2"]}]}\n```', "ok"), ('Here: {"assignments":{"0":1}} done', "ok"),
    ("", "empty"), (None, "empty"), ("```json\n```", "empty"), ('{"assignments":{"0":', "invalid"), ("[1]", "no clusters"), ('{"x":1}', "no clusters"),
])
def test_parse(content, status):
    assert responses.parse_one(content)["status"] == status


def test_compact_assignments_and_recovery(spark):
    df = spark.createDataFrame([(1, '{"assignments":{"0":"a","1":"a","2":"b","-1":"b","x":"b"},"labels":{"a":"A"}}', 3)], "response_id long, content string, paper_count int")
    got = {(r.pos, r.record_index, r.cluster_index, r.label) for r in responses.clusters_of_answers(df).collect()}
    assert got == {(0, 0, 0, "A"), (1, 1, 0, "A"), (2, 2, 2, "cluster b"), (3, None, 2, "cluster b"), (4, None, 2, "cluster b")}
    cut = spark.createDataFrame([(1, '{"assignments":{"0":"a","1":"b"},"lab', 2), (2, '{"assignments":{"0":"a"', 1), (3, None, 1)], "response_id long, content string, paper_count int")
    assert [(r.response_id, r.n_assigned, r.complete) for r in responses.recover_truncated(cut).collect()] == [(1, 2, True)]


def test_components_and_chain(spark):
    edges = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (5, "d"), (6, "d")]
    chain = [(10 + i, f"t{i}") for i in range(12)] + [(11 + i, f"t{i}") for i in range(12)]
    nodes = spark.createDataFrame([("x", i) for i in [*range(7), *range(10, 23)]], "name string, i int")
    e = spark.createDataFrame([("x", i, t) for i, t in edges + chain], "name string, i int, token string")
    got = {r.i: r.component for r in graph.bipartite_components(e, nodes, ["name"]).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 0, 3, 4, 5, 5] and {got[i] for i in range(10, 23)} == {10}


def cards(spark):
    rows = [("n", f"p{i}", i, t, "", y, o, c) for i, (t, y, o, c) in enumerate([("graph walk", "2001 ", ["Uni A"], ["Bo"]), ("graph edge", "2001.7", ["Uni A"], ["Bo", "Cy"]), ("", None, [], []), ("ice core", "1999", ["Lab"], ["Di"]), ("graph walk", "2001", [""], ["cy"])])]
    return spark.createDataFrame(rows, "name string, paper_id string, record_index int, title string, abstract string, year string, organization array<string>, coauthors array<string>")


def test_orders_keep_every_record(spark):
    c = cards(spark)
    assert [r.paper_id for r in selection.chronological(c).orderBy("place").collect()] == ["p3", "p0", "p4", "p1", "p2"]
    ctx = prompts.contexts(c)
    per = {(r.condition, r.repetition): sorted(r.s) for r in ctx.groupBy("condition", "repetition").agg(F.collect_list("i").alias("s")).collect()}
    assert len(per) == 8 and all(v == [0, 1, 2, 3, 4] for v in per.values())
    assert [r.i for r in prompts.similarity_chain(c).orderBy("position").collect()][:2] == [0, 1]
    size = prompts.prompt_size(c).first().tokens
    assert size == len(prompts.block_prompts(c).first().prompt) // 4


def test_tiles_give_the_same_as_one_tile(spark, monkeypatch):
    v = similarity.views(cards(spark))
    whole = sorted(map(tuple, similarity.top_neighbours(similarity.neighbour_statistics(v)).collect()))
    assert whole and all(0 <= r[5] <= 1 for r in whole)


def test_rank_and_weighted_join(spark):
    df = spark.createDataFrame([("a", i, 1 + i % 3) for i in range(50)] + [("b", 1, 5)], "g string, v int, n int")
    got = {(r.g, r.v): r.below for r in weighted_rank(df, ["g"], "v", "n", "below").collect()}
    assert got[("b", 1)] == 0 and all(got[("a", i)] == sum(1 + j % 3 for j in range(i)) for i in range(50))
    left = spark.createDataFrame([("h", i) for i in range(30)] + [("c", 1)], "k string, i int")
    right = spark.createDataFrame([("h", 30, 31, 1.0), ("c", 1, 31, 2.0)], "k string, w int, t int, x double")
    assert join_by_weight(left, right, ["k"], "w", "t", hot=2).count() == 31
    assert weighted_rank(df.where("false"), ["g"], "v", "n", "below").count() == 0


def test_no_cartesian_product_and_no_python_in_metrics(spark, data):
    from blockwise.operators import labels, metrics
    from blockwise.sources import tables as tb

    t = metrics.contingency(tb.truth(spark, data), labels.normalized_groups(tb.venue_clusters(spark, data), tb.blocks(spark, data), ["name"]), ["name"])
    plan = metrics.pairwise(t, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_chain_equals_brute_force():
    import random

    import pandas as pd

    rng = random.Random(2)
    rows = []
    for i in range(40):
        terms = rng.sample("abcdefgh", rng.randint(0, 4))
        norm = max(1, len(terms)) ** 0.5
        rows.append({"name": "n", "i": i, "paper_id": f"p{rng.randrange(10**6)}", "tv": {t: 1 / norm for t in terms} if terms else None, "ot": rng.sample(["o1", "o2", "o3"], rng.randint(0, 2)), "co": rng.sample(["c1", "c2", "c3", "c4"], rng.randint(0, 3))})

    def score(a, b):
        va, vb = a["tv"] or {}, b["tv"] or {}
        vals = [sum(w * vb.get(t, 0.0) for t, w in va.items())]
        for f in ("ot", "co"):
            if set(a[f]) | set(b[f]):
                vals.append(len(set(a[f]) & set(b[f])) / len(set(a[f]) | set(b[f])))
        return round(sum(vals) / len(vals), 9)

    left = sorted(rows, key=lambda r: r["paper_id"])
    want = [left.pop(0)]
    while left:
        want.append(min(left, key=lambda r: (-score(want[-1], r), r["paper_id"])))
        left.remove(want[-1])
    got = prompts._chain(pd.DataFrame(rows).sample(frac=1, random_state=1))
    assert list(got["i"]) == [r["i"] for r in want] and list(got["position"]) == list(range(40))


def test_systematic_sample_and_local_clusterer(spark):
    from blockwise.operators import analysis
    from blockwise.sources import service

    df = spark.createDataFrame([("a", i, i % 2) for i in range(25)] + [("b", i, 0) for i in range(3)] + [(None, 1, 0)], "s string, v int, _n int").drop("_n")
    got = analysis.systematic_sample(df, ["s"], ["v"], 10)
    assert sorted((r.s or "", r.v) for r in got.collect()) == [("", 1), *[("a", v) for v in range(0, 25, 3)], *[("b", v) for v in range(3)]]
    c = spark.createDataFrame([("n", "p1", 0, ["Ox Lab"]), ("n", "p2", 1, ["ox lab"]), ("n", "p3", 2, [""])], "name string, paper_id string, record_index int, organization array<string>")
    assert sorted((r.paper_id, r.cluster_index) for r in service.by_organization(c).collect()) == [("p1", 1), ("p2", 1), ("p3", 0)]
