"""Work over a global order without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bits of a key within a cell, and of a cell's number within a group of cells.
CELL, GROUP = 12, 12
_KINDS = {"sum": F.sum, "min": F.min, "max_before": F.max, "min_after": F.min}


def _accumulated(rows: DataFrame, carried: DataFrame | None, part: Sequence[str], order: Sequence[str], kinds: dict[str, str], whole: bool, parts: int | None = None) -> DataFrame:
    """``rows`` with their figures by ``order`` within ``part``, each over the values ``_of_`` its name.

    What is carried to a part, a row of such values, stands before its rows. ``whole`` lets sums and minima take in the row itself. What comes
    after a row is walked backwards, so that every frame grows row by row.
    """
    both = rows.withColumn("_lead", F.lit(1))
    if carried is not None:
        both = both.unionByName(carried.withColumn("_lead", F.lit(0)), allowMissingColumns=True)
    if parts:
        both = both.repartition(parts, *part)

    def figure(n: str, k: str) -> Column:
        by = [F.desc(c) if k == "min_after" else F.col(c) for c in order]
        upto = 0 if whole and k in ("sum", "min") else -1
        return _KINDS[k](f"_of_{n}").over(W.partitionBy(*part).orderBy("_lead", *by).rowsBetween(W.unboundedPreceding, upto))

    return both.withColumns({n: figure(n, k) for n, k in kinds.items()}).where("_lead = 1").drop("_lead")


def running(df: DataFrame, order: Sequence[str], made: dict[str, tuple[str, Column]], keys: Sequence[str] = (), cell: int = CELL, parts: int | None = None) -> DataFrame:
    """``df`` with running figures over each key's rows by ``order``, whose first column is an integer.

    ``made`` names a figure's kind and what it is taken of: ``sum`` and ``min`` up to the row, ``max_before`` over the rows before
    it, ``min_after`` over those after it. Rows meet within cells of ``2**cell`` keys; only a row per cell is carried on, and
    those meet within groups of cells, so that no task sees all rows of a key. Null keys aren't allowed. Cells are dealt to ``parts``
    partitions, if given: rows of a few integers are so small in a shuffle that Spark would put millions of them into one.
    """
    kinds = {n: k for n, (k, _) in made.items()}
    values = [_KINDS[k](f"_of_{n}").alias(f"_of_{n}") for n, k in kinds.items()]
    carry = lambda d, *by: d.select(*keys, *by, *[F.col(n).alias(f"_of_{n}") for n in kinds])
    valued = df.withColumns({"_cell": F.expr(f"shiftright({order[0]}, {cell})"), **{f"_of_{n}": c for n, (_, c) in made.items()}})
    cells = valued.groupBy(*keys, "_cell").agg(*values).withColumn("_group", F.expr(f"shiftright(_cell, {GROUP})"))
    groups = cells.groupBy(*keys, "_group").agg(*values)
    to_group = carry(_accumulated(groups, None, keys, ["_group"], kinds, False), "_group")
    to_cell = carry(_accumulated(cells, to_group, [*keys, "_group"], ["_cell"], kinds, False), "_cell")
    return _accumulated(valued, to_cell, [*keys, "_cell"], order, kinds, True, parts).select(*df.columns, *kinds)


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row by the integer column ``order`` (unique)."""
    return running(df, [order], {name: ("sum", F.col(value))})


def trailing(df: DataFrame, order: str, rows: int, aggregates: dict[str, Column], block: int = 4096) -> DataFrame:
    """``df`` with aggregates over the last ``rows`` rows by ``order``, a dense integer key.

    Each block of keys also gets the ``rows - 1`` rows before it, so blocks are independent.
    """
    home = df.withColumn("_block", F.expr(f"{order} div {block}")).withColumn("_own", F.lit(True))
    reach = F.expr(f"({order} + {rows - 1}) div {block}")
    spread = df.withColumn("_last", reach).withColumn("_block", F.explode(F.sequence(F.expr(f"{order} div {block}") + 1, F.greatest(F.col("_last"), F.expr(f"{order} div {block}") + 1)))).where("_block <= _last").drop("_last").withColumn("_own", F.lit(False))
    frame = W.partitionBy("_block").orderBy(order).rowsBetween(-(rows - 1), 0)
    both = home.unionByName(spread)
    return both.withColumns({k: c.over(frame) for k, c in aggregates.items()}).where("_own").drop("_own", "_block")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key by ``order``."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def as_of(points: DataFrame, at: str, table: DataFrame, key: str, value_columns: Sequence[str], forward: bool, cell: int = CELL) -> DataFrame:
    """Each point with the nearest row of ``table``: the first with ``key >= at``, or the last with ``key <= at``.

    Points and rows are put in one order, in cells of the number line; what lies beyond a cell is carried to it.
    """
    row = F.struct(F.col(key).alias("k"), *[F.col(c).alias(c) for c in value_columns])
    here = table.where(F.col(key).isNotNull()).select(row.alias("r"))
    kind = here.schema["r"].dataType
    # of equal keys, rows come first in the direction that is looked from
    tagged = points.select(*points.columns, F.col(at).alias("_k"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast(kind).alias("r"))
    rows = here.select(*[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], F.col("r.k").alias("_k"), F.lit(1 if forward else 0).alias("_side"), "r")
    found = running(tagged.unionByName(rows), ["_k", "_side"], {"_found": ("min_after" if forward else "max_before", F.col("r"))}, cell=cell)
    return found.where("r is null").select(*points.columns, F.col("_found.k").alias(key), *[F.col(f"_found.{c}").alias(c) for c in value_columns])
