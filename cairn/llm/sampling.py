"""Bounded samples for the classifiers, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a hash by which rows are counted before any is ranked.
BITS = 16


def least_hashed(rows: DataFrame, group: str, hashed: Column, most: int) -> DataFrame:
    """Of each ``group`` the ``most`` distinct ``rows`` whose hashes are least, with their rank as ``nth``.

    Rows are counted by the first bits of their hash, so that only those up to the count's limit are ranked:
    about ``most`` and a 65,536th of a group. Equal hashes are ranked by the other columns.
    """
    names = rows.columns
    placed = rows.withColumn("_hash", hashed).withColumn("_bin", F.expr(f"shiftrightunsigned(_hash, {64 - BITS})"))
    bins = placed.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # at most 65,536 bins a group; the first ones that hold enough rows
    needed = bins.withColumn("_before", before).where(F.col("_before") < most).select(F.col(group).alias("_group"), F.col("_bin").alias("_first"))
    few = placed.join(needed, (F.col(group) == F.col("_group")) & (F.col("_bin") == F.col("_first")), "left_semi").distinct()
    nth = F.row_number().over(W.partitionBy(group).orderBy("_bin", "_hash", *names))
    return few.withColumn("nth", nth).where(F.col("nth") <= most).select(*names, "nth")
