"""Mixing sources to target weights.

Tokens (words) are summed per source, target shares are turned into repetition rates, and each
document is emitted floor(rate) times plus once more when a hash-seeded draw falls under the
fraction. Only the table of sources, one row each, is ever ordered as a whole; documents meet it
in an equi-join that Spark broadcasts if the written table of sources is small, or else splits by its skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.words import count_words, free_names, set_aside
from cairn.sources.tables import stored

SEED = "mix"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source_size`` and ``target`` per source, from rows ``(source, size)``.

    Sources in code-point order, null last, take the weights in turn and share all of the size.
    No target exceeds ``most`` times its source's size: the excess goes to the others by weight
    until none is above. That fixed point is found directly: by ascending size per weight, a source
    is held at its limit while the limit is at most its share of what is left. An empty
    input gives no rows; a source of size 0 gets target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (nth % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    ranked = by_source.withColumn("nth", nth).withColumn("weight", weight.cast("decimal(10,0)"))
    order = W.orderBy(F.col("source_size") / F.col("weight").cast("double"), "nth")
    limit = most * F.col("source_size")
    steps = ranked.select(
        "source", "source_size", "weight", limit.alias("most"),
        (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("rest"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast("decimal(18,0)").alias("weights"),
    )
    held = steps.withColumn("held", wide("most") * F.col("weights") <= wide("rest") * F.col("weight"))
    everyone = W.partitionBy()
    open_rest = F.max(F.when(~F.col("held"), F.col("rest"))).over(everyone)
    open_weights = F.max(F.when(~F.col("held"), F.col("weights"))).over(everyone)
    share = open_rest.cast("double") * F.col("weight").cast("double") / open_weights.cast("double")
    return held.select("source", "source_size", F.when(F.col("held"), F.col("most").cast("double")).otherwise(share).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Nulls: a null text has size 0, null sources form one source, a null doc_id is drawn as such.
    Repeated rows are mixed one by one (with equal draws); a very long text is one document like any other. Other columns
    pass through, those of these names are replaced. No rows give none.
    """
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", count_words(F.col("text")))
    (own,) = free_names(sized, "_source")
    targets = stored(source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", own), "targets")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(own))).drop(own)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("int")).cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, numbered by ``copy``.

    Other columns pass through, whatever their names; one named ``copy`` is replaced.
    """
    docs, restored = set_aside(docs.drop("copy"), ["size", "source_size", "target", "copies"])
    plan = mix_plan(docs, weights, most, seed)
    every = plan.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return restored(every.drop("size", "source_size", "target", "copies"))
