"""Per-key results when a handful of keys hold most of the rows (value-frequency compression).

Rows are first grouped by (key, value), where a hot key is spread over its many values, and only the weighted
distinct values are grouped by key. Exact distinct counts, modes and percentiles follow from the weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, weighted_rank


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): how often each value occurs under each key. Null keys and values keep their own group."""
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_rows, n_distinct): exact, nulls in ``value`` count as rows and not as a value.

    The first aggregation is on (key, value), so that a key with a third of all rows is spread over all tasks; the
    second one combines partial sums on the map side and ships one row per key and task. An empty table gives none.
    """
    f = value_frequencies(df, key, value)
    return f.groupBy("key").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"))


def weighted_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, mode_weight): the most frequent non-null value, ties go to the smallest value; null if all are null."""
    return _mode_of(value_frequencies(df, key, value))


def _mode_of(freq: DataFrame) -> DataFrame:
    # the greatest weight and then the least value, as two associative aggregates: no window over a key's rows
    known = freq.where(F.col("value").isNotNull())
    best = known.groupBy("key").agg(F.max("weight").alias("mode_weight"))
    top = (
        known.alias("f").join(best.alias("b"), (F.col("f.key").eqNullSafe(F.col("b.key"))) & (F.col("f.weight") == F.col("b.mode_weight")))
        .groupBy(F.col("f.key").alias("key")).agg(F.min("f.value").alias("mode"), F.max("f.weight").alias("mode_weight"))
    )
    keys = freq.select("key").distinct()
    return keys.alias("k").join(top.alias("t"), F.col("k.key").eqNullSafe(F.col("t.key")), "left").select(F.col("k.key").alias("key"), F.col("t.mode").alias("mode"), F.col("t.mode_weight").alias("mode_weight"))


def weighted_percentile(df: DataFrame, key: str, value: str, q: float = 0.5) -> DataFrame:
    """(key, pct): the exact lower percentile of the non-null values per key, null where there are none.

    The value with the smallest cumulated weight >= ceil(q * weight of the key). Weights are cumulated by
    range-partitioned sorting with partition offsets (``common.weighted_rank``), so that no task holds a hot key,
    however its values are spread; equal values are one weighted row.
    """
    freq = cut_lineage(value_frequencies(df, key, value))
    return _percentile_of(freq, q)


def _percentile_of(freq: DataFrame, q: float) -> DataFrame:
    f = freq.where(F.col("value").isNotNull())
    ranked = weighted_rank(f, ["key"], "value", "weight", "below").alias("r")
    total = f.groupBy("key").agg(F.sum("weight").alias("total")).alias("t")
    need = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total")))
    hit = ranked.join(total, F.col("r.key").eqNullSafe(F.col("t.key"))).where((F.col("below") < need) & (F.col("below") + F.col("weight") >= need)).select(F.col("r.key").alias("key"), F.col("value").alias("pct"))
    keys = freq.select("key").distinct()
    return keys.alias("k").join(hit.alias("h"), F.col("k.key").eqNullSafe(F.col("h.key")), "left").select(F.col("k.key").alias("key"), F.col("h.pct").alias("pct"))


def hot_keys(df: DataFrame, key: str, value: str, share: float = 0.02) -> DataFrame:
    """(key, n_distinct, share): keys whose distinct values make up more than ``share`` of all distinct (key, value).

    At most 1/share keys can qualify. Null values are no value; a null key is a key like any other. A redelivered
    row changes nothing. An empty table gives no rows.
    """
    per_key = distinct_per_key(df, key, value)
    total = per_key.agg(F.sum("n_distinct")).scalar()  # one number, read as a scalar subquery
    return per_key.select("key", "n_distinct", (F.col("n_distinct") / total).alias("share")).where(F.col("share") > share)


def block_sizes(raw: DataFrame) -> DataFrame:
    """Per name: the true paper_count (distinct papers), delivered rows, the usual and the median stated paper_count.

    Two groupings: (name, paper_id) for the sizes, and (name, paper_count), written once, for mode and median; the
    stated counts are few values per name.
    """
    sizes = distinct_per_key(raw, "name", "paper_id")
    stated = cut_lineage(value_frequencies(raw, "name", "paper_count"))
    mode = _mode_of(stated).withColumnRenamed("key", "mk")
    med = _percentile_of(stated, 0.5).withColumnRenamed("key", "pk")
    return (
        sizes.join(mode, sizes["key"].eqNullSafe(mode["mk"]), "left").join(med, sizes["key"].eqNullSafe(med["pk"]), "left")
        .select(F.col("key").alias("name"), "n_rows", F.col("n_distinct").alias("paper_count"), F.col("mode").alias("stated_mode"), F.col("pct").alias("stated_median"))
    )
