"""Hash trees over ordered leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.sources.tables import stored


def node_hash(left: Column, right: Column | None, at: Column) -> Column:
    """sha256 over the hashes of a node's parts: its data or children, and an offset of 32 bytes."""
    part = lambda b: F.unhex(F.sha2(b, 256))
    offset = part(F.unhex(F.lpad(F.hex(at), 64, "0")))
    parts = [part(left), offset] if right is None else [part(left), part(right), offset]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _leaves(leaves: DataFrame, key: str, order: str, data: str, size: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    ends = leaves.select(key, (F.row_number().over(w) - 1).alias("place"), F.col(data).cast("binary").alias("d"), F.sum(size).over(w).cast("long").alias("end"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("width"))
    return ends.select(key, F.lit(0).alias("level"), "place", node_hash(F.col("d"), None, F.col("end")).alias("h"), "end", "width")


def _above(layer: DataFrame, key: str) -> DataFrame:
    pairs = layer.groupBy(key, F.expr("cast(place div 2 as int)").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "h", "end"))).alias("x"), (F.max("level") + 1).alias("level"), F.expr("(max(width) + 1) div 2").alias("width"))
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    up = F.when(F.size("x") == 2, node_hash(a["h"], b["h"], a["end"])).otherwise(a["h"])
    return pairs.select(key, "level", "place", up.alias("h"), F.coalesce(b["end"], a["end"]).alias("end"), "width")


def layers(leaves: DataFrame, key: str, order: str, data: str, size: str) -> DataFrame:
    """``key, level, place, h, end, width`` for all nodes of the balanced tree over each key's leaves in order.

    A leaf hashes its data and end offset, a branch its children and the left one's end offset; an odd last
    node moves up as it is. Nodes of a layer pair up by their place, so a wide tree is spread over
    tasks, and the number of layers is logarithmic. Only trees that aren't at their root go on; ``width`` is
    the number of nodes in a tree's layer.
    """
    layer = stored(_leaves(leaves, key, order, data, size), "layer")
    every = layer
    while layer.where("width > 1").limit(1).count():
        layer = stored(_above(layer.where("width > 1"), key), "layer")
        every = every.unionByName(layer)
    return every


def roots(leaves: DataFrame, key: str, order: str, data: str, size: str) -> DataFrame:
    """``key, root, size`` of each key's tree."""
    top = layers(leaves, key, order, data, size).where("width = 1")
    return top.select(key, F.lower(F.hex("h")).alias("root"), F.col("end").alias("size"))


def paths(every: DataFrame, key: str) -> DataFrame:
    """``key, leaf, level, sibling, left, end``: for each leaf the other child of each branch above it, lowest first.

    ``left`` says whether that one is the left child; ``end`` is the left child's end offset. Levels at which a node moves up alone have no row.
    """
    nodes = every.where("width > 1").select(key, "level", "place", "h", "end")
    other = nodes.select(key, "level", F.expr("cast(place ^ 1 as int)").alias("place"), F.col("h").alias("sibling"), F.col("end").alias("sibling_end"))
    branched = nodes.join(other, [key, "level", "place"])
    # a leaf's node at a level is found by its place: every leaf meets one node per level
    leaves = every.where("level = 0").select(key, F.col("place").alias("leaf"), "width")
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("width")).cast("int")))).withColumn("place", F.expr("cast(shiftright(leaf, level) as int)"))
    left = F.col("place") % 2 == 1
    return levels.join(branched, [key, "level", "place"]).select(key, "leaf", "level", "sibling", left.alias("left"), F.when(left, F.col("sibling_end")).otherwise(F.col("end")).alias("end"))


def chained(values: Column) -> Column:
    """The unbalanced accumulator: each value is hashed with the hash of all before it."""
    return F.aggregate(values, F.lit(""), lambda a, v: F.sha2(F.concat(a, v).cast("binary"), 256))
