"""Joins with figures of a key whose rows may be a large part of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import stored

#: A key that more than one in so many rows have is hot; there are fewer than this of them.
HOT = 1_000


def with_figures(rows: DataFrame, figures: DataFrame, keys: Sequence[str], n: str = "n", how: str | None = None) -> DataFrame:
    """``rows`` (a stored table) joined with ``figures``, one row a key, of which ``n`` is the number of rows with the key.

    The figures of hot keys, fewer than ``HOT``, are broadcast, so that their rows stay where they are; those of the others meet by key.
    ``how`` is a hint for that join. Rows whose key has no figures are left out.
    """
    total = F.broadcast(figures.agg(F.sum(n).alias("_total")))  # one row
    marked = stored(figures.crossJoin(total).withColumn("_hot", F.col(n) * HOT > F.col("_total")).drop("_total"), "figures")
    hot = F.broadcast(marked.where("_hot").drop("_hot"))
    others = marked.where("not _hot").drop("_hot")
    cool = rows.join(hot.select(*keys), list(keys), "left_anti").join(others.hint(how) if how else others, list(keys))
    return rows.join(hot, list(keys)).unionByName(cool)
