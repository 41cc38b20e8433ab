"""Helpers shared by every operator: table access, checkpoints, global ranks."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (file or folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in spark.checkpoint.dir; where it is unset, a local session gets a folder of its own
    (tests), and a cluster an error, since executors do not share the driver's disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
            current = tempfile.mkdtemp(prefix="blockwise-checkpoint-")
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost a re-read and not a re-run."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of frames that nothing refers to any more; else they stay until the
    driver's heap happens to be collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``cut_lineage`` after a ``release``. Each stage takes a block of 4 MB and a thread on the driver while it starts, so
    a plan of dozens of exchanges, which start together, is made in such steps of few."""
    release(df.sparkSession)
    return cut_lineage(df)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name like ``wish`` which the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in taken:
        name = "_" + name
    return name


def weighted_rank(df: DataFrame, group: list[str], order: str | list[str], weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group that sort before this one.

    The rows are range-partitioned by (group, order) and sorted within partitions, each partition adds up its own
    part, and the totals of the partitions before it are added as an offset. No group, however large, has to fit in
    one task. Offsets are needed for groups that reach over a border of partitions only, of which there are fewer than
    partitions; they are worked out on the driver and broadcast. Rows with equal (group, order) must have been merged
    before, else their order is arbitrary.
    """
    spark = df.sparkSession
    orders = [order] if isinstance(order, str) else order
    pid = "_part"
    ranged = cut_lineage(df.repartitionByRange(*group, *orders).sortWithinPartitions(*group, *orders).withColumn(pid, F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, T.StructField(out, T.LongType())])
    arrow_schema = pa.schema([*_arrow_fields(ranged), pa.field(out, pa.int64())])

    def local_sums(batches):
        last, run = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(g)) for g in [pid, *group]]
            w = b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(w), dtype=bool)
            for c in keys:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(c[0].as_py() for c in keys)
            new[0] = True
            before = np.concatenate([[0], np.cumsum(w)[:-1]])
            starts = np.flatnonzero(new)
            base = before[starts]
            if first == last:
                base[0] -= run  # the group goes on from the batch before
            sums = before - np.repeat(base, np.diff(np.append(starts, len(w))))
            last, run = tuple(c[len(w) - 1].as_py() for c in keys), int(sums[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums)], schema=arrow_schema)

    # the checkpoint keeps the partitions, one task each, in sorted order
    summed = ranged.mapInArrow(local_sums, schema)
    totals = ranged.groupBy(pid, *group).agg(F.sum(weight).alias("_total"))
    wide = totals.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(pid, "_total")).alias("_parts")).where("_n > 1")
    offsets = []
    for r in wide.collect():  # fewer groups than partitions
        seen = 0
        for part in sorted(r["_parts"], key=lambda x: x[pid]):
            offsets.append((part[pid], *(r[g] for g in group), seen))
            seen += part["_total"]
    fields = [T.StructField("_p", T.IntegerType()), *(T.StructField(f"_g{i}", ranged.schema[g].dataType) for i, g in enumerate(group)), T.StructField("_off", T.LongType())]
    off = spark.createDataFrame(offsets, T.StructType(fields))
    cond: Column = summed[pid] == off["_p"]
    for i, g in enumerate(group):
        cond = cond & summed[g].eqNullSafe(off[f"_g{i}"])
    joined = summed.join(F.broadcast(off), cond, "left")
    return joined.select(*df.columns, (F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).alias(out))


def numbered_within(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the rows of each group numbered from 0 in the given order, without a task that holds a whole group.

    Only the columns named are sorted and numbered, nulls first; (group, order) must be unique.
    """
    keys = df.select(*group, *order).withColumn("_one", F.lit(1))
    ranks = weighted_rank(keys, group, order, "_one", "_no").select(*[F.col(c).alias(f"_r_{c}") for c in (*group, *order)], F.col("_no").cast("int").alias("_no"))
    same = F.lit(True)
    for c in (*group, *order):
        same = same & df[c].eqNullSafe(F.col(f"_r_{c}"))
    return df.join(ranks, same).select(*[df[c] for c in df.columns], F.col("_no").alias(out))


def _arrow_fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: str, hot: int = 2000) -> DataFrame:
    """Inner join where ``right`` has one row per key with the number of left rows (or a multiple of it) as ``weight``.

    Keys with at least 1/hot of the ``total`` (a column of ``right``) number at most ``hot`` by counting; they are
    joined by broadcast, so that no reducer gets a hot key. The rest is joined by shuffle, no key above that share.
    The key columns hold no nulls.
    """
    is_hot = F.col(weight) * hot >= F.col(total)
    first = left.join(F.broadcast(right.where(is_hot)), keys, "left")
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    rest = first.where(F.col(weight).isNull()).select(left.columns).join(right.where(~is_hot), keys)
    return first.where(F.col(weight).isNotNull()).select(columns).unionByName(rest.select(columns))
