"""Queries on tables by name, tiered reads, codecs of records, settings and pictures."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import ordered
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import shared_path, table

Spark = SparkSession


@query("SELECT 'accounts' AS family, count(*) AS n, max(c_custkey) AS last FROM customer UNION ALL SELECT 'blocks', count(*), max(o_orderkey) FROM orders UNION ALL SELECT 'stores', count(*), max(s_suppkey) FROM supplier")
def kv_families(spark: Spark, sf_dir: str) -> DataFrame:
    """Tables opened under a name each, twice without harm, and read by their names."""
    families = {"accounts": ("customer", "c_custkey"), "blocks": ("orders", "o_orderkey"), "stores": ("supplier", "s_suppkey")}
    for _ in range(2):
        for name, (source, key) in families.items():
            table(spark, sf_dir, source).select(F.col(key).alias("key")).createOrReplaceTempView(f"family_{name}")
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS family, count(*) AS n, max(key) AS last FROM family_{n}" for n in families))


@query("""WITH idx AS (SELECT o_orderkey AS height, md5(CAST(o_orderkey AS VARCHAR)) AS hash FROM orders), cache AS (SELECT hash, height FROM idx WHERE height % 5 = 0), kv AS (SELECT hash, height FROM idx WHERE height % 3 = 0), asked AS (SELECT p_partkey * 3 AS height FROM part)
SELECT a.height, i.hash, CASE WHEN c.hash IS NOT NULL THEN 'cache' WHEN k.hash IS NOT NULL THEN 'store' WHEN i.hash IS NOT NULL THEN 'unavailable' ELSE 'not_found' END AS found_in FROM asked a LEFT JOIN idx i USING (height) LEFT JOIN cache c ON c.hash = i.hash LEFT JOIN kv k ON k.hash = i.hash""")
def block_read(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks asked for by height: the index gives the hash, and the first tier that has it the block."""
    idx = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"))
    tier = lambda every, name: idx.where(f"height % {every} = 0").select("hash", F.lit(True).alias(name))
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("height"))
    found = asked.join(idx, "height", "left").join(tier(5, "in_cache"), "hash", "left").join(tier(3, "in_store"), "hash", "left")
    return found.select("height", "hash", F.when(F.col("in_cache"), "cache").when(F.col("in_store"), "store").when(F.col("hash").isNotNull(), "unavailable").otherwise("not_found").alias("found_in"))


_VERSIONS = "v AS (SELECT o_custkey AS address, o_orderkey // 500 AS root, o_orderkey AS height, CAST(round(o_totalprice * 100) AS BIGINT) AS balance FROM orders)"


@query(f"WITH {_VERSIONS}, roots AS (SELECT DISTINCT root FROM v) SELECT r.root, address, arg_max(balance, height) AS balance FROM roots r JOIN v ON v.root <= r.root WHERE r.root = 1 GROUP BY 1, 2")
def wallet_list(spark: Spark, sf_dir: str) -> DataFrame:
    """All accounts as they were at a root: the newest version of each up to it."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.expr("o_orderkey div 500").alias("root"), F.col("o_orderkey").alias("height"), F.round(F.col("o_totalprice") * 100).cast("long").alias("balance"))
    return v.where("root <= 1").groupBy("address").agg(F.max_by("balance", "height").alias("balance")).select(F.lit(1).cast("long").alias("root"), "address", "balance").join(v.where("root = 1").select("root").distinct(), "root", "left_semi")


@query(f"WITH {_VERSIONS} SELECT l_suppkey AS id, l_orderkey AS height, arg_max(balance, v.height) AS balance FROM lineitem JOIN v ON v.address = l_suppkey AND v.root <= l_orderkey // 500 GROUP BY 1, 2")
def account_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    """The balance of an address at the root of a height: of its versions by root, the last one up to that."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.expr("o_orderkey div 500").alias("root")).agg(F.max_by(F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderkey").alias("balance"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("height")).distinct().withColumn("root", F.expr("height div 500"))
    both = v.select("id", "root", F.lit(0).alias("side"), "balance", F.lit(None).cast("long").alias("height")).unionByName(asked.withColumns({"side": F.lit(1), "balance": F.lit(None).cast("long")}))
    last = F.last("balance", True).over(W.partitionBy("id").orderBy("root", "side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("b", last).where("side = 1 and b is not null").select("id", "height", F.col("b").alias("balance"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderkey % 50 AS anchor, CAST(round(o_totalprice) AS BIGINT) AS priority, o_orderkey % 997 AS size FROM orders)
SELECT 'size' AS idx, 'all' AS key, CAST(sum(size) AS BIGINT) AS value FROM p UNION ALL SELECT 'owner', CAST(owner AS VARCHAR), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'anchor', CAST(anchor AS VARCHAR), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'priority', CAST(priority // 100000 AS VARCHAR), max(id) FROM p GROUP BY 2 UNION ALL SELECT 'status', CASE WHEN id % 3 = 0 THEN 'ready' ELSE 'waiting' END, count(*) FROM p GROUP BY 2""")
def mempool_indexes(spark: Spark, sf_dir: str) -> DataFrame:
    """The five indexes of a pool of transactions in one pass over its rows: sizes, owners, anchors, priorities, states."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 50).alias("anchor"), F.round("o_totalprice").cast("long").alias("priority"), (F.col("o_orderkey") % 997).alias("size"))
    entry = lambda name, key, total, newest: F.struct(F.lit(name).alias("idx"), key.cast("string").alias("key"), total.cast("long").alias("total"), newest.cast("long").alias("newest"))
    none, one = F.lit(None), F.lit(1)
    entries = F.array(entry("size", F.lit("all"), F.col("size"), none), entry("owner", F.col("owner"), one, none), entry("anchor", F.col("anchor"), one, none), entry("priority", F.expr("priority div 100000"), none, F.col("id")), entry("status", F.when(F.col("id") % 3 == 0, "ready").otherwise("waiting"), one, none))
    rows = o.select(F.explode(entries).alias("x")).select("x.*")
    return rows.groupBy("idx", "key").agg(F.coalesce(F.sum("total"), F.max("newest")).alias("value"))


@query(f"{sql('blocks', 'idx')} SELECT height, end_offset, miner, true AS index_same, true AS history_same, true AS wallet_same FROM idx")
def codec_roundtrip(spark: Spark, sf_dir: str) -> DataFrame:
    """Entries of the block index, of a reward history and of a page of accounts written as JSON and read again."""
    b = views.block_index(spark, sf_dir).select("height", "end_offset", "miner", "reward")
    raw = F.col("height").cast("string").cast("binary")
    index = F.struct(scalars.base64url(F.unhex(F.sha2(raw, 256))).alias("hash"), F.col("end_offset").cast("string").alias("weave_size"), F.lit("").alias("tx_root"))
    history = F.array(F.struct(F.col("miner").cast("string").alias("addr"), F.col("reward").cast("string").alias("reward")))
    wallet = F.struct(F.array(F.struct(F.col("miner").cast("string").alias("address"), F.col("reward").cast("string").alias("balance"))).alias("wallets"), F.lit("last").alias("last"))

    def same(value: Column, kind: str) -> Column:
        return F.to_json(F.from_json(F.to_json(value), kind)) == F.to_json(value)

    return b.select("height", "end_offset", "miner", same(index, "hash string, weave_size string, tx_root string").alias("index_same"), same(history, "array<struct<addr:string,reward:string>>").alias("history_same"),
                    same(wallet, "wallets array<struct<address:string,balance:string>>, last string").alias("wallet_same"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'json' ELSE 'toml' END AS format, s_suppkey + 1000 AS port, s_name AS name FROM supplier")
def config_sources(spark: Spark, sf_dir: str) -> DataFrame:
    """Settings in JSON or TOML, one text per row, parsed into the same fields; a text in neither would give nulls."""
    k = F.col("s_suppkey")
    text = F.when(k % 2 == 0, F.to_json(F.struct(F.struct((k + 1000).alias("port")).alias("network"), F.col("s_name").alias("name")))).otherwise(F.concat(F.lit('name = "'), "s_name", F.lit('"\n[network]\nport = '), (k + 1000).cast("string")))
    s = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "json").otherwise("toml").alias("format"), text.alias("text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ports, names = [], []
            for kind, t in zip(b.column("format").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    got = json.loads(t) if kind == "json" else tomllib.loads(t)
                except ValueError:
                    got = {}
                ports.append(got.get("network", {}).get("port"))
                names.append(got.get("name"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("format"), pa.array(ports, pa.int64()), pa.array(names, pa.string())], ["id", "format", "port", "name"])

    return s.mapInArrow(parsed, "id long, format string, port long, name string")


@query("""WITH c AS (SELECT l_suppkey AS line, l_orderkey % 16 AS col, max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS shade FROM lineitem GROUP BY 1, 2), g AS (SELECT line, unnest(range(16)) AS col FROM (SELECT DISTINCT line FROM c)) SELECT line, string_agg(CAST(coalesce(shade, 0) * 80 AS VARCHAR), ' ' ORDER BY g.col) AS pixels FROM g LEFT JOIN c USING (line, col) GROUP BY line""")
def packing_bitmap(spark: Spark, sf_dir: str) -> DataFrame:
    """A picture of packings, a line of grey values per store, written as text and read back."""
    shade = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("line"), (F.col("l_orderkey") % 16).cast("int").alias("col"), shade.alias("shade"))
    wide = li.groupBy("line").pivot("col", list(range(16))).agg(F.max("shade"))
    pixels = F.concat_ws(" ", *[(F.coalesce(F.col(str(c)), F.lit(0)) * 80).cast("string") for c in range(16)])
    path = shared_path(spark, "bitmap")
    wide.select(F.concat_ws("\t", F.col("line").cast("string"), pixels).alias("value")).write.text(path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].cast("long").alias("line"), parts[1].alias("pixels"))


@query(f"{sql('forks')}, seen AS (SELECT height, parent, max(height) OVER (ORDER BY height ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM forks) SELECT height, parent, (SELECT count(*) FROM forks c WHERE c.parent = seen.height) AS children, coalesce(height > top, true) AS raises FROM seen")
def dag_insert(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks put into the tree one by one: each one's children, and whether it raised the top when it came."""
    f = views.forks(spark, sf_dir).select("height", "parent")
    children = f.groupBy(F.col("parent").alias("height")).agg(F.count(F.lit(1)).alias("children"))
    topped = ordered.running(f, ["height"], {"top": ("max_before", F.col("height"))})
    return topped.join(children, "height", "left").select("height", "parent", F.coalesce("children", F.lit(0).cast("long")).alias("children"), F.coalesce(F.col("height") > F.col("top"), F.lit(True)).alias("raises"))
