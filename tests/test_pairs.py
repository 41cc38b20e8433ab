"""Pairs of a block: whole texts, and results that do not need all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from blockwise.operators import prompts as pm
from blockwise.operators import router as rt
from blockwise.operators import similarity as sm
from blockwise.plans import queries

CARD = "name string, paper_id string, record_index int, title string, abstract string, organization array<string>, coauthors array<string>"


def two_long_abstracts(spark):
    """Two papers whose abstracts are the same for 1,200 characters and differ after that."""
    same = "word " * 240
    cards = spark.createDataFrame([("n", "a", 0, "one", same + "left " * 400, [], []), ("n", "b", 1, "two", same + "right " * 400, [], [])], CARD)
    return cards, spark.createDataFrame([("n", "a", "x"), ("n", "b", "x")], "name string, paper_id string, label string")


def test_pair_records_read_whole_abstracts(spark):
    row = sm.pair_records(*two_long_abstracts(spark), digits=6).first()
    assert row["abstract_available"] and row["abstract_cosine_similarity"] < 0.5


def test_pair_records_of_a_text_after_blanks(spark):
    cards, truth = two_long_abstracts(spark)
    cards = cards.selectExpr("name", "paper_id", "record_index", "title", "repeat(' ', 1200) || 'late words' AS abstract", "organization", "coauthors")
    row = sm.pair_records(cards, truth, digits=6).first()
    assert row["abstract_available"] and row["abstract_cosine_similarity"] == 1


def test_field_separation_reads_whole_abstracts(spark):
    row = sm.field_separation(*two_long_abstracts(spark)).where("field = 'abstract'").first()
    assert row["available_pair_count"] == 1 and row["same_mean"] < 0.5 and row["different_mean"] is None


def refuse(*_, **__):
    raise AssertionError("not needed for this result")


@pytest.mark.parametrize("name", ["j08_changed_pairs", "w15_example_cases", "a18_field_separation"])
def test_results_without_rows_of_all_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(sm, "block_pairs", refuse)
    monkeypatch.setattr(sm, "TILE", 4)  # blocks of several tiles
    compare(spark, data, queries.QUERIES[name], queries.SQL[name])


def test_only_wanted_contexts_are_worked_out(spark, data, monkeypatch):
    for name in ("similarity_chain", "random_order", "_chained", "_shuffled"):
        monkeypatch.setattr(pm, name, refuse, raising=False)
    compare(spark, data, queries.QUERIES["q02_t16_context_prompts"], queries.SQL["q02_t16_context_prompts"])


def test_products_come_from_shared_terms_only():
    import numpy as np

    keys = [["a", "b"], [], ["b", "c"], ["d"]]
    rows = pm._Rows(keys, [[0.6, 0.8], [], [0.5, 0.5], [1.0]])
    whole = np.array([[dict(zip(k, v)).get(t, 0.0) for t in "abcd"] for k, v in zip(keys, [[0.6, 0.8], [], [0.5, 0.5], [1.0]])])
    for k in range(4):
        assert np.allclose(rows.products(k), whole @ whole[k])
    assert list(rows.rows[rows.starts[1]:rows.starts[2]]) == [0, 2]  # the records that hold "b"


@pytest.mark.parametrize("dense", [0, 1000])
def test_features_of_blocks_in_chunks_without_stored_statistics(spark, data, monkeypatch, dense):
    """Classes of equal papers in several chunks, listwise and densely; block features store no statistics of papers."""
    monkeypatch.setattr(rt, "cut_lineage", refuse)
    monkeypatch.setattr(sm, "CHUNK", 8, raising=False)
    monkeypatch.setattr(sm, "DENSE", dense, raising=False)
    compare(spark, data, queries.QUERIES["t13_block_features"], queries.SQL["t13_block_features"])


@pytest.mark.parametrize("dense", [0, 1000])
def test_nearest_papers_equal_brute_force(spark, monkeypatch, dense):
    import random

    rng = random.Random(5)
    docs = [(i, sorted(rng.sample(range(9), rng.randint(1, 3)))) for i in range(60)]
    v = spark.createDataFrame([("n", "coauthor", i, True, t, [1.0] * len(t)) for i, t in docs], "name string, view string, i int, available boolean, terms array<bigint>, weights array<double>")
    monkeypatch.setattr(sm, "CHUNK", 16, raising=False)
    monkeypatch.setattr(sm, "DENSE", dense, raising=False)
    got = {r["i"]: r for r in sm.neighbour_statistics(v).collect()}
    assert len(got) == 60
    for i, t in docs:
        near = sorted(((round(len({*t} & {*u}) / len({*t} | {*u}), 9), j) for j, u in docs if j != i), reverse=True)
        assert [(x["sim"], x["j"]) for x in got[i]["top"]] == near[:4] and got[i]["n"] == 59
        assert abs(got[i]["total"] - sum(s for s, _ in near)) < 1e-6 and abs(got[i]["squares"] - sum(s * s for s, _ in near)) < 1e-6


def test_field_separation_forms_no_list_of_pairs(spark, data, monkeypatch):
    monkeypatch.setattr(sm, "each_pair", refuse)
    monkeypatch.setattr(sm, "TILE", 4)
    assert list(sm._tallied(np.array([3, 1, 3]), 4)[1]) == [1, 2] == list(sm._tallied(np.array([3, 1, 3]), 1 << 40)[1])
    tiles = list(range(3)), list(range(3, 6))
    side = lambda k: sm._Side(pa.array([[{"i": i, "author": i % 2, "title_ok": i != 4, "abstract_ok": False, "tt": [1, i % 3], "tw": [0.6, 0.8], "at": [], "aw": [], "ot": [i], "co": []} for i in tiles[k]]], pa.list_(pa.struct([(c, pa.int64()) for c in ("i", "author")] + [(c, pa.bool_()) for c in ("title_ok", "abstract_ok")] + [(c, pa.list_(pa.float64() if c[1] == "w" else pa.int64())) for c in ("tt", "tw", "at", "aw", "ot", "co")]))), 0)
    monkeypatch.setattr(sm, "_sides", lambda _: iter([(side(0), side(1), False), (side(0), side(0), True)]))
    (got,) = sm._counts(None)([])
    per = {}
    for r in got.to_pylist():
        per[r["field"]] = per.get(r["field"], 0) + r["w"]
    assert per == {0: 9, 2: 12}


def test_pair_records_lie_in_partitions_of_equal_work(spark, monkeypatch):
    monkeypatch.setattr(sm, "TILE", 4)
    cards = spark.createDataFrame([(name, f"{name}{i:03}", i, "some title", "", [], []) for name, n in (("big", 150), ("small", 3), ("tiny", 1)) for i in range(n)], CARD)
    found = sm.pair_records(cards, cards.selectExpr("name", "paper_id", "'x' AS label"), digits=6)
    per_task = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    pairs = {(r.author_block, r.paper_i, r.paper_j) for r in found.collect()}
    assert pairs == {(name, f"{name}{i:03}", f"{name}{j:03}") for name, n in (("big", 150), ("small", 3)) for j in range(n) for i in range(j)}
    assert sum(r["count"] for r in per_task) == len(pairs)
    assert max(r["count"] for r in per_task) < 2 * 150 * 149 / 2 / 7  # a block of 38 tiles has 7 groups
