"""Queries on hash trees, proofs, hashed histories, tries, codecs and checks of fields."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import folds, merkle
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import stored, table

Spark = SparkSession
PIECE = 1024

_CHUNKS = f"ch AS (SELECT doc_id, i AS pos, substr(text, i * {PIECE} + 1, {PIECE}) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {PIECE}.0) AS BIGINT))) AS i FROM documents))"
_AT = "unhex(lpad(lower(hex({0})), 64, '0'))"
_NODES = f"""leaf AS (SELECT doc_id, pos, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e, count(*) OVER (PARTITION BY doc_id) AS width FROM ch),
nodes AS (SELECT doc_id, CAST(0 AS BIGINT) AS level, CAST(pos AS BIGINT) AS place, unhex(sha256(unhex(sha256(encode(piece))) || unhex(sha256({_AT.format('e')})))) AS h, e, CAST(width AS BIGINT) AS width FROM leaf UNION ALL
SELECT doc_id, level + 1, place // 2, CASE WHEN n = 2 THEN unhex(sha256(unhex(sha256(h)) || unhex(sha256(h2)) || unhex(sha256({_AT.format('e')})))) ELSE h END, CASE WHEN n = 2 THEN e2 ELSE e END, (width + 1) // 2
FROM (SELECT *, lead(h) OVER w AS h2, lead(e) OVER w AS e2, CASE WHEN place % 2 = 0 AND place + 1 < width THEN 2 ELSE 1 END AS n FROM nodes WHERE width > 1 WINDOW w AS (PARTITION BY doc_id, level ORDER BY place)) WHERE place % 2 = 0)"""


def _chunks(spark: Spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(scalars.pieces(F.col("text"), PIECE)).alias("pos", "piece"))
    return d.withColumn("size", F.length("piece").cast("long"))


@query(f"WITH RECURSIVE {_CHUNKS}, {_NODES} SELECT doc_id, lower(hex(h)) AS root, e AS size FROM nodes WHERE width = 1")
def merkle_roots(spark: Spark, sf_dir: str) -> DataFrame:
    """Roots of the balanced trees over each document's chunks."""
    return merkle.roots(_chunks(spark, sf_dir), "doc_id", "pos", "piece", "size")


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(pos AS BIGINT) AS leaf, true AS sound, false AS forged FROM ch")
def merkle_proof_check(spark: Spark, sf_dir: str) -> DataFrame:
    """Each chunk's path to its root made, and followed from the chunk and from a changed one: the first ends in the root."""
    every = merkle.layers(_chunks(spark, sf_dir), "doc_id", "pos", "piece", "size")
    every = stored(every, "nodes")
    paths = merkle.paths(every, "doc_id").groupBy("doc_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "sibling", "left", "end"))).alias("path"))
    roots = every.where("width = 1").select("doc_id", F.col("h").alias("root"))
    leaves = every.where("level = 0").select("doc_id", F.col("place").alias("leaf"), "h").join(paths, ["doc_id", "leaf"], "left").join(roots, "doc_id")

    def climbed(start: Column) -> Column:
        step = lambda h, x: F.when(x["left"], merkle.node_hash(x["sibling"], h, x["end"])).otherwise(merkle.node_hash(h, x["sibling"], x["end"]))
        return F.coalesce(F.aggregate("path", start, step), start)

    return leaves.select("doc_id", F.col("leaf").cast("long").alias("leaf"), (climbed(F.col("h")) == F.col("root")).alias("sound"), (climbed(F.unhex(F.sha2("h", 256))) == F.col("root")).alias("forged"))


_BLOB = "unhex(sha256(unhex(sha256(encode('blob' || CAST(strlen({0}) AS VARCHAR)))) || unhex(sha256(encode({0})))))"
_LIST = "unhex(sha256({0} || {1}))"


@query(f"""SELECT c_custkey AS address, lower(hex({_LIST.format(_LIST.format("unhex(sha256(encode('list2')))", _BLOB.format("c_name")), _LIST.format(_LIST.format("unhex(sha256(encode('list2')))", _BLOB.format("c_mktsegment")), _BLOB.format("CAST(c_nationkey AS VARCHAR)")))})) AS h FROM customer""")
def deep_hash(spark: Spark, sf_dir: str) -> DataFrame:
    """The tagged hash of nested lists: a name and a list of a segment and a nation."""
    c = table(spark, sf_dir, "customer")
    h = scalars.deep_hash([F.col("c_name"), [F.col("c_mktsegment"), F.col("c_nationkey").cast("string")]], 256)
    return c.select(F.col("c_custkey").alias("address"), F.lower(F.hex(h)).alias("h"))


def _up(level: int) -> str:
    return f"t{level} AS (SELECT k[1:{level}] AS k, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM t{level + 1} GROUP BY k[1:{level}])"


@query(f"""WITH t4 AS (SELECT lpad(lower(hex(c_custkey)), 4, '0') AS k, sha256(lpad(lower(hex(c_custkey)), 4, '0') || ':' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR)) AS h FROM customer WHERE c_custkey < 65536), {', '.join(map(_up, (3, 2, 1)))} SELECT k AS prefix, h FROM t1""")
def trie_hash(spark: Spark, sf_dir: str) -> DataFrame:
    """Hashes of the account trie's branches: children are hashed together in the order of their keys, and a lone one passes up as it is."""
    a = views.accounts(spark, sf_dir).where("address < 65536")
    key = F.lpad(F.lower(F.hex("address")), 4, "0")
    level = a.select(key.alias("k"), F.sha2(F.concat_ws(":", key, F.col("balance").cast("string")).cast("binary"), 256).alias("h"))
    for n in (3, 2, 1):
        children = F.sort_array(F.collect_list(F.struct("k", "h")))["h"]  # sixteen at most
        level = level.groupBy(F.substring("k", 1, n).alias("k")).agg(children.alias("x")).select("k", F.when(F.size("x") == 1, F.get("x", F.lit(0))).otherwise(F.sha2(F.array_join("x", "").cast("binary"), 256)).alias("h"))
    return level.withColumnRenamed("k", "prefix")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS miner, CAST(o_orderkey AS VARCHAR) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), c AS (SELECT miner, r, sha256(v) AS h FROM o WHERE r = 1 UNION ALL SELECT o.miner, o.r, sha256(c.h || o.v) FROM c JOIN o ON o.miner = c.miner AND o.r = c.r + 1) SELECT miner, arg_max(h, r) AS h, max(r) AS n FROM c GROUP BY miner""")
def history_hash(spark: Spark, sf_dir: str) -> DataFrame:
    """The hash over each miner's whole history: every element is hashed with the hash of all before it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("miner"), F.col("o_orderkey").alias("height"))

    def step(state: tuple[str, int], row: tuple) -> tuple[tuple[str, int], list]:
        return (hashlib.sha256(f"{state[0]}{row[0]}".encode()).hexdigest(), state[1] + 1), []

    return folds.folded(o, ["miner"], ["height"], "miner long, h string, n long", lambda: ("", 0), step, lambda s: [s])


@query("SELECT c_custkey AS address, c_custkey % 3 <> 2 AS valid, CASE WHEN c_custkey % 3 <> 2 THEN c_name || '-0123456789' END AS decoded FROM customer")
def address_checksum(spark: Spark, sf_dir: str) -> DataFrame:
    """Addresses with and without a checksum decoded; every third has a wrong one and isn't valid."""
    name = F.concat("c_name", F.lit("-0123456789")).cast("binary")
    k = F.col("c_custkey") % 3
    code = F.when(k == 0, scalars.base64url(name)).when(k == 1, scalars.with_checksum(name)).otherwise(F.concat(scalars.base64url(name), F.lit(":AAAAAA")))
    back = scalars.decoded_address(code)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), back.isNotNull().alias("valid"), back.cast("string").alias("decoded"))


@query("""SELECT o_orderkey AS n, o_orderkey * 100 // 3000 AS partition, (o_orderkey * 100 // 256) * 256 AS bucket_start, (o_orderkey * 100 // 256 + 1) * 256 AS bucket_end, (o_orderkey * 100 % 8192) // 64 * 68 AS file_at, o_orderkey * 100 // 8192 * 8192 AS file_start,
CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 * 3000 AS recall, (o_orderkey // 16) % 32 AS entropy, o_orderkey % 16 AS slice FROM orders""")
def offset_math(spark: Spark, sf_dir: str) -> DataFrame:
    """Where an offset lies: partition, bucket, file and place in it, entropy and slice; and the recall range of a hash."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    recall = F.conv(F.substring(F.sha2(F.col("n").cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long") % 100 * 3000
    return o.select("n", F.expr("n * 100 div 3000").alias("partition"), F.expr("n * 100 div 256 * 256").alias("bucket_start"), F.expr("(n * 100 div 256 + 1) * 256").alias("bucket_end"), F.expr("n * 100 % 8192 div 64 * 68").alias("file_at"),
                    F.expr("n * 100 div 8192 * 8192").alias("file_start"), recall.alias("recall"), F.expr("n div 16 % 32").alias("entropy"), (F.col("n") % 16).alias("slice"))


@query("""WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'infinity' WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS raw, [200, 204, 301, 404, 429, 503, 100][1 + p_partkey % 7] AS code FROM part)
SELECT id, raw, CASE WHEN raw = 'infinity' THEN true ELSE false END AS infinite, TRY_CAST(raw AS BIGINT) AS number, CASE WHEN TRY_CAST(raw AS BIGINT) IS NOT NULL THEN lpad(CAST(strlen(raw) AS VARCHAR), 2, '0') || raw END AS coded,
CASE code // 100 WHEN 2 THEN 'success' WHEN 3 THEN 'redirection' WHEN 4 THEN 'client-error' WHEN 5 THEN 'server-error' ELSE 'unknown' END AS status, id * 1000000 + 7 AS seconds, CASE WHEN id % 4 = 0 THEN NULL ELSE round(CAST(id AS DOUBLE) / (id % 4), 6) END AS ratio,
CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS flag, CAST(id * 3 AS VARCHAR) || ' MiB' AS shown, CASE id % 3 WHEN 0 THEN 'rsa' WHEN 1 THEN 'ecdsa' ELSE 'eddsa' END AS signature FROM v""")
def scalar_codecs(spark: Spark, sf_dir: str) -> DataFrame:
    """Numbers with infinity, length-prefixed numbers, classes of status codes, times in parts, safe division, flags, sizes, kinds of signature."""
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "infinity").when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    code = F.element_at(F.array(*map(F.lit, (200, 204, 301, 404, 429, 503, 100))), (k % 7 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(k.alias("id"), raw.alias("raw"), code.alias("code"))
    i, number = F.col("id"), scalars.number(F.col("raw"))
    return p.select("id", "raw", scalars.is_infinite(F.col("raw")).alias("infinite"), number.alias("number"), scalars.length_prefixed(F.when(number.isNotNull(), F.col("raw"))).alias("coded"), scalars.status_class(F.col("code")).alias("status"),
                    scalars.seconds_of(i, F.lit(7)).alias("seconds"), F.round(scalars.safe_ratio(i, i % 4), 6).alias("ratio"), (i % 2 == 0).cast("int").alias("flag"), scalars.as_mib(i * 3 * 1_048_576).alias("shown"), scalars.signature_kind(i % 3).alias("signature"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'unpacked' WHEN s_suppkey % 4 = 1 THEN 'spora_2_6' WHEN s_suppkey % 4 = 2 THEN 'composite' ELSE 'replica_2_9' END AS kind, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS address, CASE WHEN s_suppkey % 4 = 2 THEN s_nationkey + 1 ELSE 0 END AS difficulty,
'storage_module_' || s_suppkey || '_' || CASE WHEN s_suppkey % 4 = 0 THEN 'unpacked' WHEN s_suppkey % 4 = 1 THEN 'spora_2_6_' || s_name WHEN s_suppkey % 4 = 2 THEN 'composite_' || s_name || '.' || (s_nationkey + 1) ELSE 'replica_2_9_' || s_name END AS label FROM supplier""")
def module_labels(spark: Spark, sf_dir: str) -> DataFrame:
    """Storage modules named by number and packing, and packings taken apart again."""
    k, at = F.col("s_suppkey") % 4, (F.col("s_nationkey") + 1).cast("string")
    kind = F.when(k == 1, "spora_2_6").when(k == 2, "composite").when(k == 3, "replica_2_9")
    packing = F.when(k == 0, "unpacked").otherwise(F.concat(kind, F.lit("_"), "s_name", F.when(k == 2, F.concat(F.lit("."), at)).otherwise("")))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), packing.alias("packing"))
    return s.select("id", scalars.packing_kind(F.col("packing")).alias("kind"), scalars.packing_address(F.col("packing")).alias("address"), scalars.packing_difficulty(F.col("packing")).alias("difficulty"), F.concat_ws("_", F.lit("storage_module"), F.col("id").cast("string"), "packing").alias("label"))


@query("""WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'true' WHEN c_custkey % 6 = 1 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 6 = 2 THEN '10.0.0.' || (c_custkey % 256) WHEN c_custkey % 6 = 3 THEN CAST(c_custkey * 70 AS VARCHAR) WHEN c_custkey % 6 = 4 THEN '/data/' || c_custkey ELSE 'no such' END AS raw FROM customer)
SELECT id, raw, CASE WHEN raw IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(raw, '[0-9]+') AND CAST(raw AS BIGINT) BETWEEN 1 AND 65535 THEN 'port' WHEN regexp_full_match(raw, '[0-9]+') THEN 'integer' WHEN regexp_full_match(raw, '([0-9]{1,3}[.]){3}[0-9]{1,3}') THEN 'address' WHEN raw[1] = '/' THEN 'path' ELSE 'error' END AS kind FROM v""")
def config_types(spark: Spark, sf_dir: str) -> DataFrame:
    """What a setting's text can be read as."""
    k = F.col("c_custkey")
    text = k.cast("string")
    raw = F.when(k % 6 == 0, "true").when(k % 6 == 1, text).when(k % 6 == 2, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).when(k % 6 == 3, (k * 70).cast("string")).when(k % 6 == 4, F.concat(F.lit("/data/"), text)).otherwise("no such")
    r = F.col("raw")
    number = scalars.number(r)
    kind = F.when(r.isin("true", "false"), "boolean").when(number.between(1, 65535), "port").when(number.isNotNull(), "integer").when(r.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "address").when(r.startswith("/"), "path").otherwise("error")
    return table(spark, sf_dir, "customer").select(k.alias("id"), raw.alias("raw")).select("id", "raw", kind.alias("kind"))


_TX = "tx AS (SELECT l_orderkey AS height, l_linenumber AS line, l_suppkey AS target, CAST(l_quantity AS BIGINT) AS size, CAST(round(l_extendedprice * 100) AS BIGINT) AS reward, l_returnflag AS flag, l_partkey AS part FROM lineitem)"


@query(f"""WITH {_TX} SELECT height, line, array_to_string(list_filter([CASE WHEN size > 45 THEN 'too_large' END, CASE WHEN reward < size * 90000 THEN 'fee_too_low' END, CASE WHEN flag = 'R' AND target % 3 = 0 THEN 'bad_format' END, CASE WHEN part % 50 = 0 THEN 'target_is_owner' END], lambda x: x IS NOT NULL), ',') AS failed,
size * 4 >= 100 OR reward * 2 >= size * 200000 AS attractive FROM tx""")
def tx_checks(spark: Spark, sf_dir: str) -> DataFrame:
    """All checks that a transaction fails, by name in order; and whether its chunk is worth its proof."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("target"), F.col("l_quantity").cast("long").alias("size"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("reward"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    size, reward = F.col("size"), F.col("reward")
    checks = [F.when(size > 45, "too_large"), F.when(reward < size * 90000, "fee_too_low"), F.when((F.col("flag") == "R") & (F.col("target") % 3 == 0), "bad_format"), F.when(F.col("part") % 50 == 0, "target_is_owner")]
    return t.select("height", "line", F.concat_ws(",", *checks).alias("failed"), ((size * 4 >= 100) | (reward * 2 >= size * 200000)).alias("attractive"))


@query(f"""{sql('blocks', 'forks')} SELECT b.height, CASE WHEN b.height > 200 AND b.size > 300 THEN 'block_too_large' WHEN length(CAST(b.reward AS VARCHAR)) > 7 AND b.height % 2 = 0 THEN 'reward_field_too_long' WHEN f.parent <> b.height - 1 THEN 'wrong_parent'
WHEN sha256(CAST(b.height AS VARCHAR)) < '08' THEN 'below_difficulty' WHEN b.ts % 172800 = 0 AND b.miner % 10 = 0 THEN 'bad_timestamp' ELSE 'valid' END AS verdict FROM blocks b JOIN forks f USING (height)""")
def block_rules(spark: Spark, sf_dir: str) -> DataFrame:
    """The first of a block's rules in order that it breaks; some hold from a height on only."""
    b = views.blocks(spark, sf_dir).join(views.forks(spark, sf_dir).select("height", "parent"), "height")
    h = F.col("height")
    verdict = (
        F.when((h > 200) & (F.col("size") > 300), "block_too_large").when((F.length(F.col("reward").cast("string")) > 7) & (h % 2 == 0), "reward_field_too_long").when(F.col("parent") != h - 1, "wrong_parent")
        .when(F.sha2(h.cast("string").cast("binary"), 256) < "08", "below_difficulty").when((F.col("ts") % 172800 == 0) & (F.col("miner") % 10 == 0), "bad_timestamp").otherwise("valid")
    )
    return b.select("height", verdict.alias("verdict"))


@query("SELECT p_partkey AS id, p_name AS back FROM part")
def xor_cipher(spark: Spark, sf_dir: str) -> DataFrame:
    """Parts ciphered with bytes drawn from their key and deciphered again; gives what came back."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").cast("binary").alias("data"))
    once = scalars.ciphered(p, "id", "data")
    return scalars.ciphered(once, "id", "data").select("id", F.col("data").cast("string").alias("back"))


@query(f"WITH {_CHUNKS} SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS data, count(*) AS chunks, sum(length(piece)) > 12000 AS too_big FROM ch GROUP BY doc_id")
def tx_payload(spark: Spark, sf_dir: str) -> DataFrame:
    """Payloads put together from all their chunks in order, and whether they are too big to be served at once."""
    c = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("x"), F.sum("size").alias("n"))
    return c.select("doc_id", F.array_join(F.col("x")["piece"], "").alias("data"), F.size("x").cast("long").alias("chunks"), (F.col("n") > 12000).alias("too_big"))


@query("SELECT l_suppkey % 3 AS disk, count(DISTINCT l_suppkey) AS stores, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used, 10000000 - CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS free FROM lineitem GROUP BY 1")
def disk_totals(spark: Spark, sf_dir: str) -> DataFrame:
    """Stores, use and free space of each disk."""
    used = F.sum(F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("disk")).agg(F.countDistinct("l_suppkey").alias("stores"), F.count(F.lit(1)).alias("n"), used.alias("used"), (10_000_000 - used).alias("free"))


@query("SELECT l_suppkey AS store, l_returnflag AS error, count(*) AS chunks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey), 6) AS percent FROM lineitem GROUP BY 1, 2")
def verification_report(spark: Spark, sf_dir: str) -> DataFrame:
    """Errors of each store by kind, with their bytes and share of the store's chunks."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store"), F.col("l_returnflag").alias("error")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    totals = li.groupBy("store").agg(F.sum("chunks").alias("all"))
    return li.join(totals, "store").select("store", "error", "chunks", "bytes", F.round(100.0 * F.col("chunks") / F.col("all"), 6).alias("percent"))


@query("WITH o AS (SELECT o_custkey AS address, o_orderkey AS version, o_orderkey % 7 AS value FROM orders), f AS (SELECT address, value, min(version) AS first FROM o GROUP BY 1, 2) SELECT address, string_agg(CAST(value AS VARCHAR), ',' ORDER BY first) AS distinct_values, count(*) = (SELECT count(*) FROM o WHERE o.address = f.address) AS unique_ FROM f GROUP BY address")
def distinct_ordered(spark: Spark, sf_dir: str) -> DataFrame:
    """Each address's values without repetitions, in the order in which they first came, and whether none was repeated."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("address"), (F.col("o_orderkey") % 7).alias("value")).agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("first", "value")))
    g = o.groupBy("address").agg(listed.alias("x"), F.max("n").alias("most"))
    return g.select("address", F.array_join(F.transform("x", lambda v: v["value"].cast("string")), ",").alias("distinct_values"), (F.col("most") == 1).alias("unique_"))


@query("SELECT l_partkey AS part, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS stores, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def invert_map(spark: Spark, sf_dir: str) -> DataFrame:
    """From stores and their parts to parts and the set of their stores."""
    of_store = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store")).agg(F.collect_set("l_partkey").alias("parts"))
    rows = of_store.select(F.col("store").cast("string").alias("store"), F.explode("parts").alias("part"))
    return rows.groupBy("part").agg(F.array_sort(F.collect_set("store")).alias("s")).select("part", F.array_join("s", ",").alias("stores"), F.size("s").cast("long").alias("n"))


@query("SELECT user_id AS peer, user_id % 8 = 0 AS loopback, user_id % 8 = 0 AND user_id % 3 <> 0 AS dropped FROM (SELECT DISTINCT user_id FROM events)")
def loopback_peers(spark: Spark, sf_dir: str) -> DataFrame:
    """Peers on the own machine, dropped unless their port is a custom one."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    text = F.concat(F.when(F.col("user_id") % 8 == 0, "127.").otherwise("13."), (F.col("user_id") % 256).cast("string"), F.lit(".0.1:"), F.when(F.col("user_id") % 3 == 0, "2000").otherwise("1984"))
    loop = text.startswith("127.")
    return u.select(F.col("user_id").alias("peer"), loop.alias("loopback"), (loop & (F.split_part(text, F.lit(":"), F.lit(2)) == "1984")).alias("dropped"))
