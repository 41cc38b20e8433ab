"""Per-name results of the skewed block index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise.common import read_table
from blockwise.operators import hot_keys


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hot_keys(read_table(spark, d, "sna_valid_raw"), "name", "paper_id").select(F.col("key").alias("name"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.block_sizes(read_table(spark, d, "sna_valid_raw"))


QUERIES = {"p2_found": p2_found, "p2_sizes": p2_sizes}

SQL = {
    "p2_found": """
WITH d AS (SELECT DISTINCT name, paper_id FROM sna_valid_raw WHERE paper_id IS NOT NULL)
SELECT name FROM d GROUP BY name HAVING count(*) > 0.02 * (SELECT count(*) FROM d)""",
    "p2_sizes": """
WITH m AS (SELECT name, paper_count AS v, count(*) AS w FROM sna_valid_raw WHERE paper_count IS NOT NULL GROUP BY ALL),
mode AS (SELECT name, v AS stated_mode FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY w DESC, v) = 1),
med AS (SELECT name, quantile_disc(paper_count, 0.5) AS stated_median FROM sna_valid_raw WHERE paper_count IS NOT NULL GROUP BY name),
s AS (SELECT name, count(*) AS n_rows, count(DISTINCT paper_id) AS paper_count FROM sna_valid_raw GROUP BY name)
SELECT s.name, n_rows, s.paper_count, stated_mode, stated_median FROM s LEFT JOIN mode USING (name) LEFT JOIN med USING (name)""",
}
