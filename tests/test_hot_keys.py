"""The hot-key operator against brute force, and its edge cases."""

import random
from collections import Counter, defaultdict

from blockwise.operators import hot_keys


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", rng.choice([None, *range(40)]), str(rng.randrange(300))) for _ in range(1500)] + [(None, 3, "a"), (None, None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "name string, v int, id string")
    by, ids = defaultdict(list), defaultdict(set)
    for k, v, i in rows:
        by[k].append(v)
        if i is not None:
            ids[k].add(i)
    d = {r.key: (r.n_rows, r.n_distinct) for r in hot_keys.distinct_per_key(df, "name", "id").collect()}
    assert d == {k: (len(v), len(ids[k])) for k, v in by.items()}
    mode = {r.key: r["mode"] for r in hot_keys.weighted_mode(df, "name", "v").collect()}
    pct = {r.key: r.pct for r in hot_keys.weighted_percentile(df, "name", "v", 0.5).collect()}
    for k, vs in by.items():
        known = sorted(x for x in vs if x is not None)
        if not known:
            assert mode[k] is None and pct[k] is None
            continue
        c = Counter(known)
        assert mode[k] == min(x for x in c if c[x] == max(c.values()))
        assert pct[k] == known[-(-len(known) // 2) - 1]
    total = sum(map(len, ids.values()))
    assert {r.key for r in hot_keys.hot_keys(df, "name", "id", 0.1).collect()} == {k for k in ids if len(ids[k]) > 0.1 * total}


def test_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, "x", 9, 9)] * 3, "name string, v int, id string, key int, value int")
    assert [tuple(r) for r in hot_keys.distinct_per_key(df, "name", "id").collect()] == [("a", 3, 1)]
    none = df.where("false")
    assert hot_keys.hot_keys(none, "name", "id").count() == 0
    assert hot_keys.weighted_percentile(none, "name", "v").count() == 0
    assert hot_keys.weighted_mode(none, "name", "v").count() == 0


def test_rank_over_batches_and_partitions(spark):
    from blockwise.common import numbered_within, weighted_rank

    rng = random.Random(1)
    cells = {(rng.choice(["a", "b", None]), rng.randrange(5000)): rng.randrange(1, 9) for _ in range(3000)}
    df = spark.createDataFrame([(g, v, w, 1) for (g, v), w in cells.items()], "g string, v int, w int, _part2 int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {(r.g, r.v): r.below for r in weighted_rank(df, ["g"], "v", "w", "below").collect()}
    no = {(r.g, r.v): r.no for r in numbered_within(df.where("g is not null"), ["g"], ["v", "w"], "no").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("a", "b", None):
        run = 0
        for k, v in enumerate(sorted(v for h, v in cells if h == g)):
            assert got[g, v] == run and (g is None or no[g, v] == k)
            run += cells[g, v]
    assert weighted_rank(df.where("false"), ["g"], "v", "w", "below").count() == 0
