"""Responses as a file stream, kept as a latest-wins table. An extension: the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockwise.common import cut_lineage

SCHEMA = "response_id long, request_id long, content string, finish_reason string, received_at timestamp"


def response_stream(spark: SparkSession, path: str, delay: str = "2 days") -> DataFrame:
    """New response files as rows; a redelivered response within the delay is dropped, later ones are kept."""
    s = spark.readStream.schema(SCHEMA).parquet(path)
    return s.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["response_id"])


def latest(responses: DataFrame) -> DataFrame:
    """The newest response per request, by time and then id."""
    cols = [c for c in responses.columns if c != "request_id"]
    m = F.max(F.struct("received_at", "response_id", *[c for c in cols if c not in ("received_at", "response_id")]))
    return responses.groupBy("request_id").agg(m.alias("m")).select("request_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def keep_latest(stream: DataFrame, table: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Merge every micro-batch into a versioned table, the newest response per request winning; see ``read_latest``.

    The table is kept in ``parts`` folders by a hash of the request. A batch reads and rewrites only the folders it has
    requests of, each under a new version v=<epoch>, and publishes them by writing a pointer file last; readers follow
    the newest pointer, so a crash in between leaves the version before. A repeated epoch writes the same again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = cut_lineage(latest(batch).withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int")))
        touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # at most ``parts``
        if not touched:
            return
        known = _versions(spark, table, before=epoch)
        old = [f"{table}/data/v={known[p]}/part={p}" for p in touched if p in known]
        columns = [c for c in fresh.columns if c != "part"]
        merged = fresh.select(columns)
        if old:
            merged = latest(merged.unionByName(spark.read.parquet(*old).select(columns)))
        merged.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(parts)).cast("int")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/data/v={epoch}")
        pointer = [(p, v) for p, v in sorted((known | dict.fromkeys(touched, epoch)).items())]
        spark.createDataFrame(pointer, "part int, version long").coalesce(1).write.mode("overwrite").json(f"{table}/pointers/{epoch:020d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The version of each part by the newest finished pointer (older than ``before``); at most one row a part."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/pointers/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    epochs = sorted(f.getPath().getParent().getName() for f in found)
    epochs = [e for e in epochs if before is None or int(e) < before]
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version long").json(f"{table}/pointers/{epochs[-1]}").collect()} if epochs else {}


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The published rows of a table kept by ``keep_latest``."""
    known = _versions(spark, table)
    return spark.read.parquet(*[f"{table}/data/v={v}/part={p}" for p, v in known.items()])


def windowed_counts(events: DataFrame, time: str = "received_at", kind: str = "finish_reason", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, kind, n): rows per tumbling window and kind, late rows within the delay included."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "kind", "n")
