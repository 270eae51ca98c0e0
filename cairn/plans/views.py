"""Ledger views over the order, line item, customer, supplier, part, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.intervals import merge
from cairn.operators.ordered import running_sum
from cairn.sources.tables import stored, table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``height, size, miner, reward, ts``: an order is a block, its line items' quantities its size."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("height")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("miner"), F.round(F.col("o_totalprice") * 100).cast("long").alias("reward"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return base.join(sizes, "height", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with ``end_offset``, the archive's size after each, and ``start_offset``."""
    indexed = running_sum(blocks(spark, sf_dir), "height", "size", "end_offset")
    return indexed.withColumn("start_offset", F.col("end_offset") - F.col("size"))


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions; equal ones are told apart by ``n``."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("target"), F.col("l_quantity").cast("long").alias("size"),
                      F.round(F.col("l_extendedprice") * 100).cast("long").alias("reward"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("address"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"), (1 + F.col("c_nationkey") % 2).cast("int").alias("denomination"))


def sync_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ranges ``(set_id, start, end]``: a line item per supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("set_id"), (F.col("l_orderkey") * 10).alias("start"), (F.col("l_orderkey") * 10 + F.col("l_quantity").cast("long")).alias("end"))


def merged_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ranges merged, and written: joins by level look at them more than once."""
    return stored(merge(sync_record(spark, sf_dir)), "merged")


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size")).cast("long").alias("end"))


def peer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("peer"), (F.col("user_id") % 16).alias("subnet"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") != "error").cast("int").alias("success"), F.round(F.col("value") * 100).cast("long").alias("latency"), "event_type", "props")


def forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``height, parent, miner, diff``: each block's parent is the one before, every 97th's lies up to five blocks back."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderkey") - 1 - F.col("o_orderkey") % 5).otherwise(F.col("o_orderkey") - 1).alias("parent"), F.col("o_custkey").alias("miner"), (1 + F.col("o_custkey") % 9).alias("diff"))


#: The same views for DuckDB, as the start of a WITH clause.
SQL = {
    "blocks": "blocks AS (SELECT o_orderkey AS height, CAST(coalesce(size, 0) AS BIGINT) AS size, o_custkey AS miner, CAST(round(o_totalprice * 100) AS BIGINT) AS reward, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)",
    "idx": "idx AS (SELECT *, CAST(sum(size) OVER (ORDER BY height) AS BIGINT) AS end_offset, CAST(sum(size) OVER (ORDER BY height) AS BIGINT) - size AS start_offset FROM blocks)",
    "txs": "txs AS (SELECT l_orderkey AS height, l_linenumber AS line, l_suppkey AS target, CAST(l_quantity AS BIGINT) AS size, CAST(round(l_extendedprice * 100) AS BIGINT) AS reward, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS format, count(*) AS n FROM lineitem GROUP BY ALL)",
    "accounts": "accounts AS (SELECT c_custkey AS address, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, 1 + c_nationkey % 2 AS denomination FROM customer)",
    "rec": "rec AS (SELECT l_suppkey AS set_id, l_orderkey * 10 AS \"start\", l_orderkey * 10 + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem)",
    "black": "black AS (SELECT p_partkey * 100 AS \"start\", p_partkey * 100 + p_size AS \"end\" FROM part)",
    "pe": "pe AS (SELECT event_id, user_id AS peer, user_id % 16 AS subnet, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS success, CAST(round(value * 100) AS BIGINT) AS latency, event_type, props FROM events)",
    "forks": "forks AS (SELECT o_orderkey AS height, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 - o_orderkey % 5 ELSE o_orderkey - 1 END AS parent, o_custkey AS miner, 1 + o_custkey % 9 AS diff FROM orders)",
    "merged": "marked AS (SELECT *, CASE WHEN \"start\" > max(\"end\") OVER (PARTITION BY set_id ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM rec), isl AS (SELECT *, sum(f) OVER (PARTITION BY set_id ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS g FROM marked), merged AS (SELECT set_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM isl GROUP BY set_id, g)",
}


def sql(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
