"""Interval sets of ``(start, end]`` rows, one set per value of the key columns.

Sets are canonical when their intervals are disjoint and not adjacent. Sweeps run per key and cell of the number
line, with what a cell needs from others carried to it, so that a large set is many tasks. Joins of intervals and
points meet on cells of the size of the longer one, never by comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.ordered import running
from cairn.sources.tables import stored

#: Bits of an offset within a cell of a sweep.
CELL = 20


def _celled(rows: DataFrame, at: str, keys: Sequence[str], made: dict[str, str]) -> DataFrame:
    """``rows`` with their ``_place`` by ``at``, and for each cell one that stands before them with what came in earlier ones: the ``sum`` or ``max`` of columns."""
    celled = rows.withColumn("_place", F.expr(f"shiftright({at}, {CELL})"))
    cells = celled.groupBy(*keys, "_place").agg(*[(F.sum if k == "sum" else F.max)(c).alias(c) for c, k in made.items()])
    before = running(cells, ["_place"], {f"_{c}": ("sum" if k == "sum" else "max_before", F.col(c)) for c, k in made.items()}, keys)
    came = [(F.col(f"_{c}") - F.col(c) if k == "sum" else F.col(f"_{c}")).alias(c) for c, k in made.items()]
    carried = before.select(*keys, "_place", (F.expr(f"shiftleft(_place, {CELL})") - 1).alias(at), *came).dropna(subset=list(made))
    return celled.select(*keys, "_place", at, *made).unionByName(carried)


def _followed(rows: DataFrame, at: str, figure: str, keys: Sequence[str]) -> DataFrame:
    """``rows``, with their ``_place``, and ``_next``, the figure of the next one of their key by ``at``; figures grow along it.

    What a cell's rows tell each other is stored, so that only a cell's last row is looked at again.
    """
    w = W.partitionBy(*keys, "_place").orderBy(at)
    head = F.first(figure).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    here = stored(rows.withColumns({"_next": F.lead(figure).over(w), "_tail": F.lead(at).over(w).isNull(), "_head": head}), "followed")
    tails = running(here.where("_tail").drop("_next"), ["_place"], {"_next": ("min_after", F.col("_head"))}, keys)
    return here.where("not _tail").unionByName(tails).drop("_tail", "_head", "_place")


def merge(df: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """The canonical form: overlapping and adjacent intervals become one.

    An interval that none before it reaches opens an island, and where the next one opens the one before had reached its end.
    """
    some = df.where("end > start").select(*keys, "start", "end").dropna(subset=list(keys))
    w = W.partitionBy(*keys, "_place").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    reached = _celled(some, "start", keys, {"end": "max"}).withColumn("_reach", F.max("end").over(w))
    opens = reached.where(f"shiftright(start, {CELL}) = _place and (_reach is null or start > _reach)").select(*keys, "_place", "start", "_reach")
    last = some.groupBy(*keys).agg(F.max("end").alias("_last"))
    followed = _followed(opens, "start", "_reach", keys).select(*keys, "start", F.col("_next").alias("end"))
    open_ = followed.where("end is null").drop("end").join(last, list(keys)).withColumnRenamed("_last", "end")  # one of a key
    return followed.where("end is not null").unionByName(open_)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    cols = [*keys, "start", "end"]
    return merge(a.select(*cols).unionByName(b.select(*cols)), keys)


def _swept(a: DataFrame, b: DataFrame, keys: Sequence[str], wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """What is covered as ``wanted`` says of how many intervals of each set cover it, canonical.

    The borders are summed up along the line; only those at which it begins or ceases to be wanted are kept and paired.
    """

    def ends(df: DataFrame, which: str) -> DataFrame:
        one = lambda at, d: df.select(*keys, F.col(at).alias("at"), F.lit(d if which == "a" else 0).cast("long").alias("da"), F.lit(d if which == "b" else 0).cast("long").alias("db"))
        return one("start", 1).unionAll(one("end", -1))

    w = W.partitionBy(*keys, "_place").orderBy("at")
    upto, here = w.rangeBetween(W.unboundedPreceding, W.currentRow), w.rangeBetween(W.currentRow, W.currentRow)
    sums = {"in_a": F.sum("da").over(upto), "in_b": F.sum("db").over(upto), "here_a": F.sum("da").over(here), "here_b": F.sum("db").over(here), "_before": F.lag("at").over(w)}
    swept = _celled(ends(a, "a").unionAll(ends(b, "b")), "at", keys, {"da": "sum", "db": "sum"}).withColumns(sums)
    # of the borders at one place, the first stands for all
    first = swept.where(f"shiftright(at, {CELL}) = _place and (_before is null or _before < at)")
    now, before = wanted(F.col("in_a"), F.col("in_b")), wanted(F.col("in_a") - F.col("here_a"), F.col("in_b") - F.col("here_b"))
    turns = first.where(now != before).select(*keys, "_place", "at", now.alias("opens"))
    return _followed(turns, "at", "at", keys).where("opens").select(*keys, F.col("at").alias("start"), F.col("_next").alias("end"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """What ``a`` covers and ``b`` doesn't, canonical."""
    return _swept(a, b, keys, lambda in_a, in_b: (in_a > 0) & (in_b <= 0))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """What both cover, canonical."""
    return _swept(a, b, keys, lambda in_a, in_b: (in_a > 0) & (in_b > 0))


def replayed(ops: DataFrame, keys: Sequence[str], seq: str, adds: str) -> DataFrame:
    """What a log of operations on intervals leaves, canonical: of those that touch a point, the last by ``seq`` decides.

    ``adds`` tells additions from removals; of one ``seq``, an addition wins. Only the last operation on an interval goes on. Elementary intervals between all borders of a key
    meet the operations in a join by level, not by comparing all with all.
    """
    ops = ops.groupBy(*keys, "start", "end").agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(adds).alias("adds"))).alias("op"))
    borders = ops.select(*keys, F.explode(F.array("start", "end")).alias("at")).distinct()
    pieces = running(borders, ["at"], {"_next": ("min_after", F.col("at"))}, keys, CELL).where("_next is not null").select(*keys, F.col("at").alias("start"), F.col("_next").alias("end"))
    met = overlap_join(pieces, ops, keys)
    last = met.groupBy(*keys, "start", "end").agg(F.max("b_op").alias("op"))
    return merge(last.where("op.adds").select(*keys, "start", "end"), keys)


def gaps(df: DataFrame, keys: Sequence[str] = ("set_id",), start: int = 0) -> DataFrame:
    """The complement from ``start`` on; the last gap of each set is open (null end)."""
    canon = merge(df, keys)
    after = _followed(canon.withColumn("_place", F.expr(f"shiftright(start, {CELL})")), "start", "start", keys).select(*keys, F.col("end").alias("_s"), F.col("_next").alias("_e"))
    head = canon.groupBy(*keys).agg(F.min("start").alias("_e")).where(F.col("_e") > start).select(*keys, F.lit(start).cast("long").alias("_s"), "_e")
    clipped = after.where(F.col("_e").isNull() | (F.col("_e") > start)).withColumn("_s", F.greatest("_s", F.lit(start)))
    return head.unionByName(clipped).withColumnsRenamed({"_s": "start", "_e": "end"})


def gaps_within(df: DataFrame, start: int, end: int, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """The uncovered parts of ``(start, end]``."""
    cut = gaps(df, keys, start).withColumn("end", F.least(F.coalesce("end", F.lit(end)), F.lit(end)))
    return cut.where("end > start")


def cut_above(df: DataFrame, offset: int) -> DataFrame:
    return df.where(F.col("start") < offset).withColumn("end", F.least("end", F.lit(offset).cast("long")))


def clip(df: DataFrame, start: int, end: int) -> DataFrame:
    cut = df.where((F.col("start") < end) & (F.col("end") > start))
    return cut.withColumns({"start": F.greatest("start", F.lit(start).cast("long")), "end": F.least("end", F.lit(end).cast("long"))})


def delete(df: DataFrame, start: int, end: int, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """``df`` without ``(start, end]``: an interval around the hole leaves two pieces."""
    left = df.select(*keys, "start", F.least("end", F.lit(start).cast("long")).alias("end"))
    right = df.select(*keys, F.greatest("start", F.lit(end).cast("long")).alias("start"), "end")
    return merge(left.unionAll(right).where("end > start"), keys)


def measure(df: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Covered length and number of intervals per set, of canonical rows."""
    return df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n"))


def overlap_with(start: int, end: int) -> Column:
    """How much of ``(start, end]`` a row covers."""
    return F.greatest(F.lit(0).cast("long"), F.least("end", F.lit(end).cast("long")) - F.greatest("start", F.lit(start).cast("long")))


def _buckets(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))))


#: The least power of eight that an interval fits into, as one of two; it touches two cells of that size at most.
_LEVEL = "(length(bin(end - start - 1)) + 2) div 3 * 3"


def _guests(df: DataFrame, levels: DataFrame, own: Column, above: bool, first: str, last: str) -> DataFrame:
    """``df`` dealt out to the cells that it touches at each of ``levels`` (one row with an array) from its own on."""
    higher = F.filter("_levels", lambda x: x > own if above else x >= own)
    spread = df.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode(higher)).drop("_levels")  # at most 22 levels
    return spread.withColumn("_at", F.explode(F.sequence(F.expr(f"shiftright({first}, _level)"), F.expr(f"shiftright({last}, _level)"))))


def _prefixed(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in ("_level", "_at", *keys) else f"b_{c}") for c in df.columns])


def _levels(df: DataFrame) -> DataFrame:
    return df.agg(F.collect_set(F.expr(_LEVEL)).alias("_levels"))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows that overlap, and are equal in ``keys``, with ``a``'s columns and ``b``'s others prefixed by ``b_``.

    A pair meets at the level of its longer interval, which is dealt out at its own level only, the other one at all
    levels above its own that the other side has; it is taken in its first common cell there. So a long interval costs two rows.
    Sides are merged by hint: stored intervals are few bytes each, so that Spark would broadcast millions of them.
    """
    a, b = a.where("end > start"), b.where("end > start")
    level = F.expr(_LEVEL)
    alone = lambda df: df.withColumn("_level", level).withColumn("_at", F.explode(F.sequence(F.expr("shiftright(start, _level)"), F.expr("shiftright(end - 1, _level)"))))
    longer_a = alone(a).join(_prefixed(_guests(b, _levels(a), level, False, "start", "end - 1"), keys).hint("merge"), [*keys, "_level", "_at"])
    longer_b = _guests(a, _levels(b), level, True, "start", "end - 1").join(_prefixed(alone(b), keys).hint("merge"), [*keys, "_level", "_at"])
    met = longer_a.unionByName(longer_b).where("start < b_end and b_start < end")
    return met.where("_at = greatest(shiftright(start, _level), shiftright(b_start, _level))").drop("_level", "_at")


def containing(points: DataFrame, point: str, b: DataFrame) -> DataFrame:
    """Each point with every interval of ``b`` that holds it (``start < point <= end``), ``b_`` prefixed."""
    b = b.where("end > start")
    alone = b.withColumn("_level", F.expr(_LEVEL)).withColumn("_at", F.explode(F.sequence(F.expr("shiftright(start, _level)"), F.expr("shiftright(end - 1, _level)"))))
    asked = _guests(points, _levels(b), F.lit(0), False, f"{point} - 1", f"{point} - 1")
    return asked.join(_prefixed(alone), ["_level", "_at"]).where(f"b_start < {point} and {point} <= b_end").drop("_level", "_at")


def is_canonical(df: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Per set whether its rows are non-empty, non-negative, disjoint and not adjacent."""
    before = running(df, ["start", "end"], {"_before": ("max_before", F.col("end"))}, keys, CELL)
    sound = (F.col("end") > F.col("start")) & (F.col("start") >= 0) & (F.col("_before").isNull() | (F.col("_before") < F.col("start")))
    return before.withColumn("_sound", sound).groupBy(*keys).agg(F.bool_and("_sound").alias("canonical"))


def shares(df: DataFrame, size: int, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """``(keys, bucket, share)``: the covered part of each bucket of ``size``, at most 1."""
    cut = _buckets(df, size).withColumn("_part", F.least("end", (F.col("_bucket") + 1) * size) - F.greatest("start", F.col("_bucket") * size))
    return cut.groupBy(*keys, F.col("_bucket").alias("bucket")).agg(F.sum("_part").alias("_sum")).select(*keys, "bucket", F.least(F.lit(1.0), F.col("_sum") / size).alias("share"))


def coarsened(buckets: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Buckets of twice the size: the mean of the shares that are there."""
    return buckets.groupBy(*keys, F.expr("bucket div 2").alias("bucket")).agg(F.avg("share").alias("share"))
