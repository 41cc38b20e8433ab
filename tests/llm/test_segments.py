"""Segments of the join of near names, and the driver's memory between its steps."""

import itertools
import re

from blockwise import common
from blockwise.llm import names


def test_a_text_looks_up_a_segment_of_every_near_one():
    words = ["".join(w) for n in (3, 4, 5) for w in itertools.product("ab", repeat=n)]
    for k, near in ((1, names._one_edit), (2, lambda a, b: names._typing_errors(a, b) <= 2)):
        for a, b in itertools.product(words, words):
            if a != b and near(a, b):
                assert names._held(a, k) & names._looked_up(b, k, True, len(b) + k), (a, b, k)


def test_persons_release_what_their_steps_leave(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(names, "release", seen.append)
    df = spark.createDataFrame([(1, "Korvanen, Maria", "Northgate Institute", "b"), (2, "Korvannen, Maria", "Northgate Institute", "b")], "entry_id long, name string, org string, block_name string")
    assert {(r.id_a, r.id_b) for r in names.person_pairs(df).collect()} == {(1, 2)} and len(seen) == 4


def test_no_plan_of_the_pairs_starts_dozens_of_exchanges_at_once(spark, monkeypatch):
    cut, seen = common.cut_lineage, []

    def counted(df):
        seen.append(len(re.findall(r"(?<!Reused)Exchange ", df._jdf.queryExecution().executedPlan().toString())))
        return cut(df)

    monkeypatch.setattr(names, "cut_lineage", counted)
    monkeypatch.setattr(common, "cut_lineage", counted)
    df = spark.createDataFrame([(1, "Korvanen, Maria", "Northgate Institute", "b"), (2, "Korvannen, Maria", "Northgate Institute", "b")], "entry_id long, name string, org string, block_name string")
    assert {(r.id_a, r.id_b) for r in names.person_pairs(df).collect()} == {(1, 2)}
    orgs = spark.createDataFrame([(1, "Northgate Institute"), (2, "Northgate  institute")], "org_id long, org string")
    assert {(r.id_a, r.id_b) for r in names.org_pairs(orgs).collect()} == {(1, 2)}
    assert seen and max(seen) <= 12, seen
