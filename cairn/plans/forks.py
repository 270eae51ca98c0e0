"""Queries on the tree of blocks: forks, reorganisations, confirmations and what waits for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import graph, intervals, ordered
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import shared_path, stored, table

Spark = SparkSession

#: Cumulative difficulties, the heaviest tip and the path down from it, for DuckDB.
TOTALS = "tot AS (SELECT height, parent, miner, diff, CAST(diff AS BIGINT) AS total FROM forks WHERE parent NOT IN (SELECT height FROM forks) UNION ALL SELECT f.height, f.parent, f.miner, f.diff, t.total + f.diff FROM tot t JOIN forks f ON f.parent = t.height)"
WALK = f"{TOTALS}, tip AS (SELECT height, total FROM tot ORDER BY total DESC, height LIMIT 1), walk AS (SELECT height, parent FROM forks WHERE height = (SELECT height FROM tip) UNION ALL SELECT f.height, f.parent FROM walk w JOIN forks f ON f.height = w.parent)"
_OFF = "off_ AS (SELECT * FROM forks WHERE height NOT IN (SELECT height FROM walk)), br AS (SELECT height, height AS root, parent AS base, 1 AS depth FROM off_ WHERE parent NOT IN (SELECT height FROM off_) UNION ALL SELECT o.height, b.root, b.base, b.depth + 1 FROM br b JOIN off_ o ON o.parent = b.height)"


# Joins of a chain with a chain are merge joins by hint: stored ids are a byte a row, so that Spark would broadcast millions of them.


def dag(spark: Spark, sf_dir: str) -> DataFrame:
    """The blocks with ``total``, their cumulative difficulty, and how they were ``walked`` within their cells, stored."""
    nodes = views.forks(spark, sf_dir).withColumnRenamed("height", "id")
    local = graph.celled(nodes, F.col("diff"))
    totals = graph.ancestors(nodes, local=local).select("id", "depth", "total")
    walked = local.select("id", F.struct("top", "exit", "depth", "sum", "own").alias("walked"))
    return stored(nodes.join(totals.hint("merge"), "id").join(walked.hint("merge"), "id"), "dag")


def heaviest(blocks: DataFrame) -> DataFrame:
    """``id, total`` of the tip of the heaviest chain; of equal ones the lowest."""
    return blocks.orderBy(F.desc("total"), "id").limit(1).select("id", "total")


def path(blocks: DataFrame) -> DataFrame:
    """``id`` of the blocks on the heaviest chain."""
    return graph.on_path(blocks, heaviest(blocks).select("id"), blocks.select("id", "walked.*"))


def branches(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All blocks, those on the heaviest chain, and the others with the ``root`` of their branch and the ``base`` it grows from."""
    blocks = dag(spark, sf_dir)
    on = stored(path(blocks), "path")
    off = blocks.join(on.hint("merge"), "id", "left_anti")
    rooted = graph.ancestors(off.select("id", "parent")).select("id", "root", F.col("depth").alias("level"))
    bases = off.select(F.col("id").alias("root"), F.col("parent").alias("base"))
    return blocks, on, stored(rooted.join(bases.hint("merge"), "root"), "branches")


@query(f"{sql('forks')}, {WALK} SELECT height FROM walk")
def longest_chain(spark: Spark, sf_dir: str) -> DataFrame:
    """The chain with the largest cumulative difficulty, which needn't be the highest."""
    return path(dag(spark, sf_dir)).select(F.col("id").alias("height"))


@query(f"{sql('forks')}, {WALK} SELECT height, miner FROM forks WHERE height NOT IN (SELECT height FROM walk)")
def orphans(spark: Spark, sf_dir: str) -> DataFrame:
    blocks = dag(spark, sf_dir)
    return blocks.join(path(blocks).hint("merge"), "id", "left_anti").select(F.col("id").alias("height"), "miner")


@query(f"{sql('forks')}, {WALK} SELECT height, CASE WHEN height IN (SELECT height FROM walk) THEN 'on_chain' WHEN height > (SELECT height FROM tip) - 300 THEN 'validated' ELSE 'pruned' END AS status FROM forks")
def dag_status(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks on the heaviest chain, side branches that may still win, and those too deep."""
    blocks = dag(spark, sf_dir)
    tip = heaviest(blocks).select(F.col("id").alias("tip"))
    j = blocks.select("id").join(path(blocks).withColumn("on", F.lit(True)).hint("merge"), "id", "left").crossJoin(F.broadcast(tip))  # one row
    return j.select(F.col("id").alias("height"), F.when(F.col("on"), "on_chain").when(F.col("id") > F.col("tip") - 300, "validated").otherwise("pruned").alias("status"))


@query(f"{sql('forks')}, {WALK}, {_OFF} SELECT root, base, max(depth) AS length, count(*) AS blocks FROM br GROUP BY 1, 2")
def fork_length(spark: Spark, sf_dir: str) -> DataFrame:
    """The longest way down each branch beside the heaviest chain, and the branch's size."""
    _, _, off = branches(spark, sf_dir)
    return off.groupBy("root", "base").agg((F.max("level") + 1).cast("int").alias("length"), F.count(F.lit(1)).alias("blocks"))


@query(f"{sql('forks')}, {WALK}, {_OFF} SELECT height, root, base >= (SELECT height FROM tip) - 400 AS valid FROM br")
def fork_valid(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a side branch leaves the chain at or above the checkpoint."""
    blocks, _, off = branches(spark, sf_dir)
    tip = heaviest(blocks).select(F.col("id").alias("tip"))
    return off.crossJoin(F.broadcast(tip)).select(F.col("id").alias("height"), "root", (F.col("base") >= F.col("tip") - 400).alias("valid"))  # one row


@query(f"""{sql('forks')}, {WALK}, done AS (SELECT max(height) AS h FROM walk JOIN forks USING (height) WHERE miner % 11 <> 0 AND height < (SELECT height FROM tip) - 20 OR height % 50 = 0)
SELECT height, (SELECT count(*) FROM walk w WHERE w.height > done.h) AS open_blocks FROM walk, done WHERE height > done.h ORDER BY height LIMIT 1""")
def earliest_not_validated(spark: Spark, sf_dir: str) -> DataFrame:
    """Down from the heaviest tip, the last of the blocks that aren't validated yet, and how many they are."""
    blocks = dag(spark, sf_dir)
    tip = heaviest(blocks).select(F.col("id").alias("tip"))
    on = blocks.join(path(blocks).hint("merge"), "id", "left_semi").crossJoin(F.broadcast(tip))  # one row
    validated = ((F.col("miner") % 11 != 0) & (F.col("id") < F.col("tip") - 20)) | (F.col("id") % 50 == 0)
    last = on.agg(F.max(F.when(validated, F.col("id"))).alias("h"))
    return on.crossJoin(F.broadcast(last)).where("id > h").agg(F.min("id").alias("height"), F.count(F.lit(1)).alias("open_blocks")).where("height is not null")  # one row


@query(f"{sql('forks')}, {WALK}, {_OFF} SELECT height FROM walk WHERE height >= (SELECT height FROM tip) - 700 UNION ALL SELECT height FROM br WHERE base >= (SELECT height FROM tip) - 700")
def dag_prune(spark: Spark, sf_dir: str) -> DataFrame:
    """What stays when blocks below a depth are pruned along with the branches that grow from them."""
    blocks, on, off = branches(spark, sf_dir)
    least = heaviest(blocks).select((F.col("id") - 700).alias("least"))
    kept = on.select("id", F.col("id").alias("base")).unionByName(off.select("id", "base"))
    return kept.crossJoin(F.broadcast(least)).where("base >= least").select(F.col("id").alias("height"))  # one row


@query(f"{sql('forks')}, bad AS (SELECT height FROM forks WHERE miner % 40 = 7 AND height % 97 BETWEEN 90 AND 96 UNION ALL SELECT f.height FROM bad b JOIN forks f ON f.parent = b.height AND NOT (f.miner % 40 = 7 AND f.height % 97 BETWEEN 90 AND 96)) SELECT height FROM forks WHERE height NOT IN (SELECT height FROM bad)")
def cascade_delete(spark: Spark, sf_dir: str) -> DataFrame:
    """What stays when invalid blocks go and all that is built on them: the blocks with no invalid one on the way to the root."""
    bad = ((F.col("miner") % 40 == 7) & (F.col("id") % 97).between(90, 96)).cast("int")
    nodes = views.forks(spark, sf_dir).withColumnRenamed("height", "id").withColumn("bad", bad)
    return graph.ancestors(nodes.select("id", "parent", "bad"), F.col("bad")).where("total = 0").select(F.col("id").alias("height"))


#: Bits of a height within a cell of blocks with one solution, and blocks in a partition of such cells.
SOLUTIONS_CELL, A_PART = 20, 500_000

_CDIFF = "cd AS (SELECT t.height, t.miner, t.total, t.total - t.diff AS prev, t.height * 31 % 401 AS solution FROM tot t)"


def _cdiffs(spark: Spark, sf_dir: str) -> DataFrame:
    b = dag(spark, sf_dir)
    return b.select(F.col("id").alias("height"), "miner", "total", (F.col("total") - F.col("diff")).alias("prev"), (F.col("id") * 31 % 401).alias("solution"))


@query(f"""{sql('forks')}, {TOTALS}, {_CDIFF} SELECT a.miner % 4 AS key, a.height AS first, b.height AS second FROM cd a JOIN cd b ON a.miner % 4 = b.miner % 4 AND a.height < b.height AND (a.total = b.total OR (a.total > b.prev AND b.total > a.prev))""")
def double_signing(spark: Spark, sf_dir: str) -> DataFrame:
    """Two blocks signed with one key that have the same cumulative difficulty, or each above the other's parent's: the ranges between parent and block overlap."""
    c = _cdiffs(spark, sf_dir).select((F.col("miner") % 4).alias("key"), "height", F.col("prev").alias("start"), F.col("total").alias("end"))
    met = intervals.overlap_join(c, c, ["key"])
    return met.where("height < b_height").select("key", F.col("height").alias("first"), F.col("b_height").alias("second"))


@query(f"""{sql('forks')}, {TOTALS}, {_CDIFF} SELECT height, solution, other, sort FROM (SELECT a.height, a.solution, b.height AS other, CASE WHEN a.total = b.total OR (a.total > b.prev AND b.total > a.prev) THEN 'double' ELSE 'any' END AS sort,
row_number() OVER (PARTITION BY a.height ORDER BY NOT (a.total = b.total OR (a.total > b.prev AND b.total > a.prev)), abs(a.height - b.height), b.height) AS r FROM cd a JOIN cd b ON a.solution = b.solution AND a.height <> b.height) WHERE r = 1""")
def solution_match(spark: Spark, sf_dir: str) -> DataFrame:
    """Another block with the same solution: one that is double-signed if there is any, else the nearest by height.

    Neighbours by height in a solution's group, and overlaps of difficulty, are enough; no two blocks need to be compared otherwise.
    """
    c = stored(_cdiffs(spark, sf_dir), "cdiffs")
    sides = {"a": ("max_before", F.col("height")), "b": ("min_after", F.col("height"))}
    beside = ordered.running(c.select("height", "solution"), ["height"], sides, ["solution"], SOLUTIONS_CELL, c.count() // A_PART + 1)
    near = beside.select("height", "solution", F.explode(F.array("a", "b")).alias("other")).where("other is not null").withColumn("sort", F.lit("any"))
    spans = c.select("solution", "height", F.col("prev").alias("start"), F.col("total").alias("end"))
    both = intervals.overlap_join(spans, spans, ["solution"]).where("height <> b_height")
    double = both.select("height", "solution", F.col("b_height").alias("other"), F.lit("double").alias("sort"))
    rank = F.row_number().over(W.partitionBy("height").orderBy(F.col("sort") != "double", F.abs(F.col("height") - F.col("other")), "other"))
    return near.unionByName(double).withColumn("r", rank).where("r = 1").drop("r")


#: The chain that was followed before the heaviest one: the one that leads to the highest side tip.
_OLD = f"{WALK}, {_OFF}, olds AS (SELECT height, parent FROM forks WHERE height = (SELECT max(height) FROM off_) UNION ALL SELECT f.height, f.parent FROM olds o JOIN forks f ON f.height = o.parent)"


def _two_chains(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the heaviest chain and of the one to the highest block beside it."""
    blocks = dag(spark, sf_dir)
    on = stored(path(blocks), "path")
    side = blocks.join(on.hint("merge"), "id", "left_anti").agg(F.max("id").alias("id")).where("id is not null")
    return on, stored(graph.on_path(blocks, side, blocks.select("id", "walked.*")), "old")


@query(f"{sql('forks')}, {_OLD} SELECT max(height) AS last_common FROM walk WHERE height IN (SELECT height FROM olds)")
def chain_intersection(spark: Spark, sf_dir: str) -> DataFrame:
    """The last block that two chains have in common."""
    new, old = _two_chains(spark, sf_dir)
    return new.join(old.hint("merge"), "id", "left_semi").agg(F.max("id").alias("last_common"))


@query(f"{sql('forks')}, {_OLD}, c AS (SELECT max(height) AS h FROM walk WHERE height IN (SELECT height FROM olds)) SELECT height, (SELECT h FROM c) AS last_common, (SELECT count(*) FROM lineitem WHERE l_orderkey = height) AS txs FROM walk WHERE height > (SELECT h FROM c)")
def hash_list_diff(spark: Spark, sf_dir: str) -> DataFrame:
    """The blocks after the last common one, with the number of their transactions; none if nothing is common."""
    new, old = _two_chains(spark, sf_dir)
    common = new.join(old.hint("merge"), "id", "left_semi").agg(F.max("id").alias("last_common"))
    later = new.crossJoin(F.broadcast(common)).where("id > last_common")  # one row
    txs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("txs"))
    return later.join(txs.hint("merge"), "id", "left").select(F.col("id").alias("height"), "last_common", F.coalesce("txs", F.lit(0).cast("long")).alias("txs"))


@query(f"""{sql('forks')}, {_OLD}, gone AS (SELECT height FROM olds WHERE height NOT IN (SELECT height FROM walk)), came AS (SELECT height FROM walk WHERE height NOT IN (SELECT height FROM olds)),
acts AS (SELECT height, 'retract' AS action FROM gone UNION ALL SELECT height, 'apply' FROM came), lost AS (SELECT DISTINCT l_partkey AS tx FROM lineitem WHERE l_orderkey IN (SELECT height FROM gone) EXCEPT SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT height FROM came))
SELECT height, action, CAST(NULL AS BIGINT) AS tx FROM acts UNION ALL SELECT NULL, 'requeue', tx FROM lost""")
def reorg_replay(spark: Spark, sf_dir: str) -> DataFrame:
    """A change to the heaviest chain: blocks taken back, blocks applied, and the transactions that only the former had, which are pending again."""
    new, old = _two_chains(spark, sf_dir)
    gone, came = old.join(new.hint("merge"), "id", "left_anti"), new.join(old.hint("merge"), "id", "left_anti")
    txs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tx"))
    lost = txs.join(gone.hint("merge"), "id", "left_semi").select("tx").distinct().join(txs.join(came.hint("merge"), "id", "left_semi").select("tx").hint("merge"), "tx", "left_anti")
    act = lambda df, name: df.select(F.col("id").alias("height"), F.lit(name).alias("action"), F.lit(None).cast("long").alias("tx"))
    return act(gone, "retract").unionAll(act(came, "apply")).unionAll(lost.select(F.lit(None).cast("long"), F.lit("requeue"), "tx"))


@query(f"{sql('forks')}, {WALK}, n AS (SELECT height, row_number() OVER (ORDER BY height) AS k FROM walk) SELECT a.height, b.height AS reported_at FROM n a JOIN n b ON b.k = a.k + 10")
def n_confirmations(spark: Spark, sf_dir: str) -> DataFrame:
    """For each block of the chain the block with which it is ten deep; the newest ones have none yet."""
    blocks = dag(spark, sf_dir)
    on = stored(blocks.join(path(blocks).hint("merge"), "id", "left_semi").select("id", "depth"), "on")
    later = on.select((F.col("depth") - 10).alias("depth"), F.col("id").alias("reported_at"))
    return on.join(later.hint("merge"), "depth").select(F.col("id").alias("height"), "reported_at")


@query(f"{sql('forks')}, {WALK} SELECT height, (SELECT height FROM tip) - height AS depth, (SELECT height FROM tip) - height >= 50 AS final FROM walk")
def finality_cut(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks of the chain and whether they lie beyond the window in which it may still change."""
    blocks = dag(spark, sf_dir)
    tip = heaviest(blocks).select(F.col("id").alias("t"))
    d = F.col("t") - F.col("id")
    return path(blocks).crossJoin(F.broadcast(tip)).select(F.col("id").alias("height"), d.alias("depth"), (d >= 50).alias("final"))  # one row


@query(f"{sql('forks')}, {WALK} SELECT height, miner, (SELECT count(*) FROM lineitem WHERE l_orderkey = height) AS txs FROM walk JOIN forks USING (height)")
def chain_dump(spark: Spark, sf_dir: str) -> DataFrame:
    """The chain from its tip down written as JSON, a line per block, and read back."""
    blocks = dag(spark, sf_dir)
    txs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("txs"))
    rows = blocks.join(path(blocks).hint("merge"), "id", "left_semi").join(txs.hint("merge"), "id", "left").select(F.col("id").alias("height"), "miner", F.coalesce("txs", F.lit(0).cast("long")).alias("txs"))
    out = shared_path(spark, "dump")
    rows.write.json(out)
    return spark.read.schema(rows.schema).json(out)


@query(f"{sql('forks')}, g AS (SELECT height, parent, lag(height) OVER (ORDER BY height) AS before FROM forks) SELECT height, parent, before, CASE WHEN before + 1 <> height THEN 'gap' ELSE 'parent' END AS fault FROM g WHERE before IS NOT NULL AND (before + 1 <> height OR parent <> before)")
def block_index_check(spark: Spark, sf_dir: str) -> DataFrame:
    """Where an index by height has a gap, or a block's parent isn't the one before."""
    f = ordered.running(views.forks(spark, sf_dir).select("height", "parent"), ["height"], {"before": ("max_before", F.col("height"))})
    fault = F.when(F.col("before") + 1 != F.col("height"), "gap").when(F.col("parent") != F.col("before"), "parent")
    return f.withColumn("fault", fault).where("before is not null and fault is not null").select("height", "parent", "before", "fault")


@query("SELECT o AS ordinal, height, miner FROM (SELECT o_orderkey AS height, o_custkey AS miner, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders) WHERE o IN (SELECT p_partkey * 7 FROM part) OR o = (SELECT count(*) - 1 FROM orders)")
def block_by_ordinal(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks by their place in the index, and the last one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("miner"))
    placed = ordered.running(o, ["height"], {"upto": ("sum", F.lit(1))}).select((F.col("upto") - 1).alias("ordinal"), "height", "miner")
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("ordinal"))
    last = placed.agg(F.max("ordinal").alias("ordinal"))
    return placed.join(asked.unionAll(last).distinct(), "ordinal", "left_semi")


@query("SELECT l_orderkey AS height, l_linenumber AS tx, o_custkey AS miner FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def confirmation_index(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks with lists of transactions taken apart into one row per transaction."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("height")).agg(F.collect_set("l_linenumber").alias("txs"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("miner"))
    return lists.join(b, "height").select("height", F.explode("txs").alias("tx"), "miner")


@query("""SELECT o_orderkey AS height, count(l_orderkey) AS missing, CASE WHEN count(l_orderkey) = 0 THEN 'ready' WHEN count(l_orderkey) > 3 THEN 'dropped' ELSE 'waiting' END AS state, max(l_shipdate) AS complete_on
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > DATE '1995-06-17' GROUP BY 1""")
def missing_dependency(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks that wait for transactions not seen by a date: ready, waiting, or dropped when too many are missing."""
    late = table(spark, sf_dir, "lineitem").where("l_shipdate > date'1995-06-17'").groupBy(F.col("l_orderkey").alias("height")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("complete_on"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height")).join(late, "height", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return b.select("height", n.alias("missing"), F.when(n == 0, "ready").when(n > 3, "dropped").otherwise("waiting").alias("state"), "complete_on")
