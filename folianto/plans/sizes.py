"""Broadcasts behind a check of their size, and rows that count once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted, up to that many), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits dealt out to all cores; a scan with at least half as many splits as cores stays as it is.

    For scans only: on other plans, asking for the partitions would run their shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def once_per_key(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row for each ``key`` of a table whose repeated rows are equal in every column.

    On a file scan only the keys and row positions are shuffled; the few surplus rows are then taken out by an anti join,
    so the wide columns stay where they were read. Frames without row positions fall back to ``dropDuplicates``.
    Rows with a null key are left out: they name no record.
    """
    try:
        at = df.select(F.col(key).alias("_k"), F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        wide = df.select(*cols, F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    except AnalysisException:
        return df.filter(F.col(key).isNotNull()).select(*cols).dropDuplicates([key])
    keep = F.min(F.struct("_f", "_i"))
    many = at.filter("_k is not null").groupBy("_k").agg(keep.alias("keep"), F.count("*").alias("n")).filter("n > 1")
    surplus = at.join(broadcast_if_small(many), "_k").filter("_f != keep._f or _i != keep._i").select("_f", "_i")
    return spread(wide.filter(F.col(key).isNotNull())).join(broadcast_if_small(surplus), ["_f", "_i"], "left_anti").select(*cols)
