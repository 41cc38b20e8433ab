"""All similar pairs between set-valued records: recursive prefix splitting with exact verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, join_by_weight

#: Records of a tile of a large node.
TILE = 512


def clean_elements(*arrays: str) -> Column:
    """Sorted distinct elements of all arrays, lower-cased, trimmed, inner white space one blank; null and empty dropped."""
    empty = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(F.col(a), empty) for a in arrays])
    clean = F.transform(F.filter(both, lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), "^ | $", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def set_classes(sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id), (classes: class_id, elements): equal sets of at least ``least`` elements form a class.

    class_id is the least id. Records are grouped by a 128-bit hash of the set, with map-side combination, so that a
    set held by a third of all records costs one row per task.
    """
    keyed = sets.where(F.size("elements") >= least).select("id", "elements", F.xxhash64(F.lit(1), "elements").alias("h1"), F.xxhash64(F.lit(2), "elements").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.first("elements").alias("elements"))
    members = keyed.select("id", "h1", "h2").distinct().join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).select("id", "class_id")
    return members, classes.select("class_id", "elements")


def _ordered(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_id, all, need): hashed elements with the rarest first; a similar set has at least ``need`` of them."""
    each = classes.select("class_id", F.explode("elements").alias("e")).select("class_id", F.xxhash64("e").alias("x"))
    counts = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    joined = join_by_weight(each, counts.withColumn("of", counts.agg(F.sum("n").alias("of")).scalar()), ["x"], "n", "of")
    sets = joined.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("all"))
    return sets.withColumn("need", F.greatest(F.lit(1), F.ceil(F.size("all") * F.lit(threshold) - F.lit(1e-9)).cast("int")))


def _compared(rows: DataFrame, threshold: float, depth: int | None = None) -> DataFrame:
    """Similar pairs within each node, in tiles of about ``TILE`` records, so that no large node is one task.

    With ``depth`` only pairs whose larger need is the depth.
    """
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    side = rows.select("node", "class_id", "all", "need", tiles.alias("tiles")).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    side = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "class_id", "all", "need", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    a, b = side.alias("a"), side.alias("b")
    both = (F.col("a.node") == F.col("b.node")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.class_id") < F.col("b.class_id"))
    both = both & ((F.col("a.own") != F.col("b.own")) | (F.col("a.p") == F.col("a.q")))
    if depth is not None:
        both = both & (F.greatest("a.need", "b.need") == depth)
    shorter, longer = F.least(F.size("a.all"), F.size("b.all")), F.greatest(F.size("a.all"), F.size("b.all"))
    near = a.join(b, both & (shorter >= F.lit(threshold - 1e-9) * longer)).where(_jaccard(F.col("a.all"), F.col("b.all")) >= F.lit(threshold - 1e-9))
    return near.select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"))


def similar_classes(classes: DataFrame, threshold: float = 0.6, node_limit: int = 48, max_depth: int = 24) -> DataFrame:
    """(class_a, class_b, similarity) with class_a < class_b and Jaccard similarity >= threshold; no pair is lost.

    Elements are ordered from rare to frequent. A set of n elements needs r = ceil(threshold n) in common with any
    similar one, so its first d common elements stand among its first n - r + d. A node of depth d is a path of d
    elements in this order and holds the sets that have them at such places: a similar pair with at least d common
    elements meets in the node of its first d. A node of at most ``node_limit`` records is compared pair by pair. A
    larger one is split on the next element if that at least halves the comparisons; the pairs that may share nothing
    but its path (r = d) are compared in it. Where splitting does not pay, and at ``max_depth``, the node is compared
    in full. Nodes are compared in tiles, and nodes of many records are joined by broadcast, so that a node of a third
    of all records is no single task. Every pair found is verified on the elements themselves.
    """
    base = _ordered(classes, threshold)
    rows = cut_lineage(base.select("class_id", "all", "need", F.lit(0).alias("at"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("n")))
    found: list[DataFrame] = []
    for depth in range(max_depth):
        until = F.least(F.size("all"), F.size("all") - F.col("need") + depth + 1)
        step = rows.where(F.col("at") < until).select("class_id", "all", "need", F.col("node").alias("parent"), F.col("n").alias("parent_n"), F.explode(F.sequence(F.col("at") + 1, until)).alias("at"))
        step = step.withColumn("node", F.xxhash64("parent", F.element_at("all", F.col("at"))))
        sizes = cut_lineage(step.groupBy("node", "parent", "parent_n").agg(F.count(F.lit(1)).alias("n")))
        total = sizes.agg(F.sum("n").alias("of"))
        if depth:
            # split or not: the squares of the children's sizes against that of the node itself
            fate = rows.groupBy("node").agg(F.max("n").alias("m")).join(sizes.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost")), "node", "left")
            fate = fate.select("node", "m", (F.coalesce("cost", F.lit(0.0)) * 2 > F.col("m").cast("double") * F.col("m")).alias("stuck"))
            fate = cut_lineage(fate.withColumn("of", fate.agg(F.sum("m").alias("of")).scalar()))
            judged = join_by_weight(rows, fate, ["node"], "m", "of")
            found.append(_compared(judged.where("stuck"), threshold))
            found.append(_compared(judged.where((~F.col("stuck")) & (F.col("need") <= depth)), threshold, depth))
            sizes = sizes.join(fate.where("not stuck").select(F.col("node").alias("parent")), "parent", "left_semi")
        kept = join_by_weight(step.select("class_id", "all", "need", "at", "node"), sizes.where("n > 1").select("node", "n").withColumn("of", total.scalar()), ["node"], "n", "of")
        last = depth == max_depth - 1
        kept = cut_lineage(kept.select("class_id", "all", "need", "at", "node", "n"))
        found.append(_compared(kept if last else kept.where(F.col("n") <= node_limit), threshold))
        rows = kept.where(F.col("n") > node_limit)
        if last or rows.isEmpty():
            break
    pairs = reduce(DataFrame.unionByName, found).distinct()
    a, b = classes.alias("ca"), classes.alias("cb")
    full = pairs.join(a, F.col("class_a") == F.col("ca.class_id")).join(b, F.col("class_b") == F.col("cb.class_id"))
    return full.select("class_a", "class_b", _jaccard(F.col("ca.elements"), F.col("cb.elements")).alias("similarity")).where(F.col("similarity") >= F.lit(threshold))


def similar_sets(df: DataFrame, id_col: str, arrays: list[str], threshold: float = 0.6, least: int = 4, **tuning) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs) of one table; see ``set_classes`` and ``similar_classes``.

    Null arrays count as empty; records with fewer than ``least`` elements and records with a null id take no part;
    repeated rows change nothing. An empty table gives two empty results.
    """
    sets = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), clean_elements(*arrays).alias("elements"))
    members, classes = set_classes(sets, least)
    classes = cut_lineage(classes)
    return members, similar_classes(classes, threshold, **tuning)


def expand_pairs(members: DataFrame, class_pairs: DataFrame) -> DataFrame:
    """(card_a, card_b): all pairs of different records in one class or in two similar classes, smaller id first."""
    m = members.select("id", "class_id")
    same = m.alias("a").join(m.alias("b"), (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    across = class_pairs.join(m.alias("a"), F.col("class_a") == F.col("a.class_id")).join(m.alias("b"), F.col("class_b") == F.col("b.class_id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    return same.unionByName(across).select(F.least("x", "y").alias("card_a"), F.greatest("x", "y").alias("card_b")).distinct()
