"""How distinctive a term is per record: hypergeometric enrichment with false-discovery adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.common import cut_lineage, join_by_weight


def latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row with the greatest version per non-null key; ties go to the greatest column values, null versions come last."""
    row = F.struct(F.col(version).alias("_v"), *[F.col(c) for c in columns])
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(row).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def term_array(columns: list[str], least: int = 4) -> Column:
    """Maximal runs of a to z after lower-casing, at least ``least`` letters long; null texts have none."""
    joined = F.concat_ws(" | ", *[F.col(c) for c in columns])
    return F.filter(F.regexp_extract_all(F.lower(joined), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= least)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x >= 1 by Stirling's series after a shift by 8; absolute error below 1e-11."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8.0
    z2 = z * z
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z2)) / z2) / z2) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def _log_choose(n, k):
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def upper_tail(k: np.ndarray, n: np.ndarray, marked: np.ndarray, total: np.ndarray) -> np.ndarray:
    """-ln P(X >= k) for X hypergeometric: n draws out of ``total`` tokens, of which ``marked`` are the term.

    Exact: the summands from k to min(n, marked) are added in log space; the vectorised loop ends when no row has a
    summand left that could change its double.
    """
    k, n, marked, total = (np.asarray(a, dtype=np.float64) for a in (k, n, marked, total))
    top = np.minimum(n, marked)
    base = _log_choose(total, n)
    first = _log_choose(marked, k) + _log_choose(total - marked, n - k) - base
    ratio_sum = np.ones_like(first)
    ratio, j = np.ones_like(first), k.copy()
    live = j < top
    while live.any():
        # P(j+1)/P(j)
        step = (marked - j) * (n - j) / ((j + 1.0) * (total - marked - n + j + 1.0))
        ratio = np.where(live, ratio * step, 0.0)
        ratio_sum += ratio
        j += 1.0
        live = live & (j < top) & ((ratio > 1e-17 * ratio_sum) | (step > 1.0))
    return np.maximum(0.0, -(first + np.log(ratio_sum)))


@F.pandas_udf(T.DoubleType())
def _enrichment(k: pd.Series, n: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    both = pd.DataFrame({"k": k, "n": n, "m": marked, "t": total})
    few = both.drop_duplicates()
    few = few.assign(s=upper_tail(few["k"].to_numpy(), few["n"].to_numpy(), few["m"].to_numpy(), few["t"].to_numpy()))
    return both.merge(few, how="left", on=["k", "n", "m", "t"])["s"]


def distinctive_terms(papers: DataFrame, columns: list[str], key: str = "id", version: str = "updated_at", least: int = 4) -> DataFrame:
    """(paper_id, term, tf, n_terms, df, cf, score, score_fdr) for every term of the latest version of every paper.

    score = -ln of the exact upper-tail probability of the term's count in the paper, given its count in the whole
    collection; score_fdr = -ln of the Benjamini-Hochberg adjusted probability within the paper. Papers without terms
    (null or empty texts) and rows with a null key give no rows; repeated rows and older versions change nothing; ties
    in probability share their adjusted value. An empty table gives an empty result.

    Terms are counted per paper in the partitioning of the version step, so only (paper, term, count) rows and partial
    collection counts are shuffled. Terms with at least 1/2000 of all tokens (at most 2000 terms) are joined by
    broadcast, the others by shuffle, where no key then has more than that share.
    """
    docs = latest(papers.select(key, version, *columns), key, version, columns).select(F.col(key).alias("paper_id"), term_array(columns, least).alias("_terms"))
    docs = docs.select("paper_id", "_terms", F.size("_terms").alias("n_terms"))
    counts = docs.select("paper_id", "n_terms", F.explode("_terms").alias("term")).groupBy("paper_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n_terms").alias("n_terms"))
    counts = cut_lineage(counts)  # read by the statistics and by both parts of the join
    total = counts.agg(F.sum("tf").alias("t"))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).withColumn("total", total.scalar())
    joined = join_by_weight(counts, stats, ["term"], "cf", "total")
    scored = joined.withColumn("score", _enrichment("tf", "n_terms", "cf", "total"))
    by_p = Window.partitionBy("paper_id").orderBy(F.col("score").desc(), "term")
    from_worst = Window.partitionBy("paper_id").orderBy(F.col("score").asc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy("paper_id"))
    # -ln(p * m / rank), cumulated as a maximum from the least significant term on
    adjusted = scored.withColumn("_a", F.col("score") - F.log(m / F.row_number().over(by_p)))
    return adjusted.withColumn("score_fdr", F.greatest(F.lit(0.0), F.max("_a").over(from_worst))).select("paper_id", "term", "tf", "n_terms", "df", "cf", "score", "score_fdr")
