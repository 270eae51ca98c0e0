"""Queries on chains, versions, hashes and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import graph
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import shared_path, table

Spark = SparkSession

@query(f"{sql('forks')}, t AS (SELECT height, height AS root, CAST(0 AS BIGINT) AS depth, CAST(diff AS BIGINT) AS total FROM forks WHERE parent NOT IN (SELECT height FROM forks) UNION ALL SELECT f.height, t.root, t.depth + 1, t.total + f.diff FROM t JOIN forks f ON f.parent = t.height) SELECT * FROM t")
def dag_depths(spark: Spark, sf_dir: str) -> DataFrame:
    """Root, depth and cumulative difficulty of every block."""
    nodes = views.forks(spark, sf_dir).select(F.col("height").alias("id"), "parent", "diff")
    return graph.ancestors(nodes, F.col("diff")).select(F.col("id").alias("height"), "root", "depth", "total")


@query(f"{sql('forks')}, t AS (SELECT height, CAST(diff AS BIGINT) AS total FROM forks WHERE parent NOT IN (SELECT height FROM forks) UNION ALL SELECT f.height, t.total + f.diff FROM t JOIN forks f ON f.parent = t.height) SELECT height, total FROM t ORDER BY total DESC, height LIMIT 1")
def fork_choice(spark: Spark, sf_dir: str) -> DataFrame:
    """The tip with the largest cumulative difficulty; the first seen wins a tie."""
    return dag_depths(spark, sf_dir).orderBy(F.desc("total"), "height").limit(1).select("height", "total")


@query(f"{sql('forks')} SELECT a.height AS height, b.height AS sibling FROM forks a JOIN forks b ON a.parent = b.parent AND a.height < b.height")
def siblings(spark: Spark, sf_dir: str) -> DataFrame:
    f = views.forks(spark, sf_dir)
    return f.select("parent", "height").join(f.select("parent", F.col("height").alias("sibling")), "parent").where("height < sibling").select("height", "sibling")


@query(f"{sql('forks')} SELECT height, sha256(CAST(height AS VARCHAR) || ',' || CAST(parent AS VARCHAR)) AS id FROM forks WHERE height % 97 = 0 ORDER BY height DESC LIMIT 20")
def recent_forks(spark: Spark, sf_dir: str) -> DataFrame:
    f = views.forks(spark, sf_dir).where("height % 97 = 0").orderBy(F.desc("height")).limit(20)
    return f.select("height", F.sha2(F.concat_ws(",", "height", "parent").cast("binary"), 256).alias("id"))


_DIFFS = "diffs AS (SELECT o_custkey AS address, o_orderkey AS version, CAST(round(o_totalprice * 100) AS BIGINT) AS balance FROM orders)"


@query(f"{sql('accounts')}, {_DIFFS}, d AS (SELECT address, arg_max(balance, version) AS b FROM diffs WHERE version <= 1000 GROUP BY address) SELECT address, coalesce(b, balance) AS balance FROM accounts LEFT JOIN d USING (address)")
def account_at_version(spark: Spark, sf_dir: str) -> DataFrame:
    """Balances at a version: the base snapshot under the diffs up to it."""
    d = table(spark, sf_dir, "orders").where("o_orderkey <= 1000").groupBy(F.col("o_custkey").alias("address")).agg(F.max_by(F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderkey").alias("b"))
    return views.accounts(spark, sf_dir).join(d, "address", "left").select("address", F.coalesce("b", "balance").alias("balance"))


@query(f"WITH {_DIFFS} SELECT address, max(version) AS version, arg_max(balance, version) AS balance, count(*) AS dropped FROM diffs WHERE version < 700 GROUP BY address UNION ALL SELECT address, version, balance, 0 FROM diffs WHERE version >= 700")
def snapshot_rebase(spark: Spark, sf_dir: str) -> DataFrame:
    """Diffs below a version are folded into the base, those above stay."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderkey").alias("version"), F.round(F.col("o_totalprice") * 100).cast("long").alias("balance"))
    base = d.where("version < 700").groupBy("address").agg(F.max("version").alias("v"), F.max_by("balance", "version").alias("balance"), F.count(F.lit(1)).alias("dropped")).select("address", F.col("v").alias("version"), "balance", "dropped")
    return base.unionAll(d.where("version >= 700").withColumn("dropped", F.lit(0).cast("long")))


def _chunks(spark: Spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(scalars.pieces(F.col("text"), 1024)).alias("pos", "piece"))
    return d.withColumn("size", F.length("piece").cast("long"))


_CHUNKS = "ch AS (SELECT doc_id, i AS pos, substr(text, i * 1024 + 1, 1024) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents))"


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(piece) AS id, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS end_offset FROM ch")
def chunk_ids(spark: Spark, sf_dir: str) -> DataFrame:
    ends = F.sum("size").over(W.partitionBy("doc_id").orderBy("pos"))
    return _chunks(spark, sf_dir).select("doc_id", "pos", F.sha2(F.col("piece").cast("binary"), 256).alias("id"), ends.alias("end_offset"))


@query("SELECT c_custkey AS address, rtrim(replace(replace(to_base64(encode(c_name)), '+', '-'), '/', '_'), '=') AS code, c_name AS back, sha256(c_name) AS hash FROM customer")
def base64url(spark: Spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    code = scalars.base64url(F.col("c_name").cast("binary"))
    return c.select(F.col("c_custkey").alias("address"), code.alias("code"), scalars.from_base64url(code).cast("string").alias("back"), F.sha2(F.col("c_name").cast("binary"), 256).alias("hash"))


@query("SELECT c_custkey AS address, lower(list_aggregate(list_transform([1, 11, 21, 31], lambda i: translate(upper(to_base(CAST('0x' || sha1(c_name)[i:i + 9] AS BIGINT), 32, 8)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '')) AS code FROM customer")
def base32(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), scalars.base32_of_hex(F.sha1(F.col("c_name").cast("binary")), 40).alias("code"))


@query("SELECT o_orderkey AS n, (o_orderkey * 1000 // 262144 + 1) * 262144 AS next, CAST(ceil(o_orderkey * 1000 / 262144.0) AS BIGINT) * 262144 AS padded, greatest(100, least(o_orderkey, 900)) AS clamped, o_orderkey // 37 AS bucket FROM orders")
def padded_offsets(spark: Spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    m = F.col("n") * 1000
    return o.select("n", scalars.ceil_to(m, scalars.CHUNK).alias("next"), scalars.padded(m).alias("padded"), scalars.clamp(F.col("n"), 100, 900).alias("clamped"), F.expr("n div 37").alias("bucket"))


@query("SELECT user_id AS peer, (user_id % 256) || '.' || (user_id // 256) || '.0.1' AS host, CASE WHEN user_id % 2 = 0 THEN 1984 ELSE 1985 END AS port, user_id % 256 NOT IN (0, 10, 127) AND NOT (user_id % 256 = 192 AND user_id // 256 = 168) AS public FROM (SELECT DISTINCT user_id FROM events)")
def peer_parse(spark: Spark, sf_dir: str) -> DataFrame:
    """Peers written as host and port; a port left out is the default, reserved hosts aren't public."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    text = F.concat((F.col("user_id") % 256).cast("string"), F.lit("."), F.expr("user_id div 256").cast("string"), F.lit(".0.1"), F.when(F.col("user_id") % 2 == 1, ":1985").otherwise(""))
    parts = F.split(text, ":")
    octet = F.split(parts[0], r"\.")
    reserved = octet[0].isin("0", "10", "127") | ((octet[0] == "192") & (octet[1] == "168"))
    return u.select(F.col("user_id").alias("peer"), parts[0].alias("host"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(1984)).alias("port"), (~reserved).alias("public"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'text/plain' ELSE 'none' END AS content_type FROM events")
def content_type_tag(spark: Spark, sf_dir: str) -> DataFrame:
    """The first tag of a name in a list of tags."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    tag = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    tags = F.array(tag("k", F.col("k")), tag(None, F.col("k")), F.when(F.col("k").cast("int") % 2 == 0, tag("Content-Type", F.lit("text/plain"))))
    first = F.get(F.filter(tags, lambda t: t["name"] == "Content-Type"), F.lit(0))["value"]
    return e.select("event_id", "k", F.coalesce(first, F.lit("none")).alias("content_type"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, true AS same FROM events")
def json_roundtrip(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    text = F.to_json(F.struct("event_id", "event_type", "k"))
    back = F.from_json(text, "event_id bigint, event_type string, k bigint")
    return e.select("event_id", "k", "event_type", (back == F.struct("event_id", "event_type", "k")).alias("same"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def csv_roundtrip(spark: Spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    path = shared_path(spark, "csv")
    c.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(c.schema).csv(path)


@query("SELECT l_suppkey AS root, max(l_orderkey) AS start, arg_max(l_partkey, struct_pack(a := l_orderkey, b := l_partkey)) AS part FROM lineitem GROUP BY 1")
def data_root_latest(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("root")).agg(F.max("l_orderkey").alias("start"), F.max_by("l_partkey", F.struct("l_orderkey", "l_partkey")).alias("part"))


@query("SELECT root, start FROM (SELECT DISTINCT l_suppkey AS root, l_orderkey AS start FROM lineitem) QUALIFY row_number() OVER (PARTITION BY root ORDER BY start DESC) <= 3")
def data_root_top_n(spark: Spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("root"), F.col("l_orderkey").alias("start")).distinct()
    return d.withColumn("r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("start")))).where("r <= 3").drop("r")


@query("SELECT s_suppkey AS session, max(l_orderkey) AS step, arg_max(l_linenumber, struct_pack(a := l_orderkey, b := l_linenumber)) AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def latest_session(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session")), F.col("session") == F.col("l_suppkey"))
    return li.groupBy("session").agg(F.max("l_orderkey").alias("step"), F.max_by("l_linenumber", F.struct("l_orderkey", "l_linenumber")).alias("line"))
