"""The queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bagminhash, decontamination, language_id, mixing, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filters, warc
from cairn.sources.tables import shared_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts, parent domains and paths that the pages have, for there is no table of lists."""
    keys = pages.select(F.explode(url_filters.keys_of(F.col("url"), 1_000)).alias("key")).distinct()
    n = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("int")
    first = F.lit("2024-01-01").cast("date")
    keys = keys.withColumn("n", n).where("n % 5 < 2")
    dated = lambda days, listed: keys.where(F.col("n") % 3 <= 2 if listed else F.col("n") % 3 < 2).select(F.when(F.col("n") % 2 == 0, "ads").otherwise("spam").alias("list"), "key", F.concat(F.lit("c"), (F.col("n") % 7).cast("string")).alias("category"), F.date_add(first, (F.col("n") % 200 + days).cast("int")).alias("dated"), F.lit(listed).alias("listed"))
    again = dated(150, True).where("category in ('c1', 'c2', 'c3')")
    return dated(0, True).unionAll(dated(60, False)).unionAll(again)


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date spread over 2024 by their id, for the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(captures(pages), listed_hosts(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs.where(~out).withColumnRenamed("doc_id", "key"))
    found = language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "toxic")
    out = lambda c: language_id.held_out(F.col(c), 4, 2)
    model = toxicity.fit(docs.withColumnRenamed("doc_id", "key"), labels.where(~out("key")))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", out("doc_id").alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.quality_rules(docs, texts=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_bagminhash": op4_bagminhash,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS payload FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS latest FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform([1, 11, 21, 31], lambda i: translate(upper(to_base(CAST('0x' || h[i:i + 9] AS BIGINT), 32, 8)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to, true AS complete FROM b""",
    "op3_mixing": rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM by_source),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
steps AS (SELECT *, 3 * source_size AS most,
  sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, nth)),
held AS (SELECT *, most * weights <= rest * weight AS held FROM steps),
targets AS (SELECT source, source_size, CASE WHEN held THEN CAST(most AS DOUBLE) ELSE
  CAST(max(CASE WHEN NOT held THEN rest END) OVER () AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(max(CASE WHEN NOT held THEN weights END) OVER () AS DOUBLE) END AS target FROM held),
rates AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rates""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_url_filters": r"""
WITH parsed AS (SELECT DISTINCT page_id, url,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.$', ''), '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
keyed AS (SELECT page_id, url, list_distinct(list_concat(
  CASE WHEN regexp_matches(host, '^(\[.*|([0-9]+\.){3}[0-9]+)$') THEN [host] ELSE
  list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END,
  list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS keys FROM parsed WHERE host IS NOT NULL),
listable AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT unnest(keys) AS key FROM keyed) WHERE CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) % 5 < 2),
entries AS (
  SELECT n, key, n % 200 AS day, true AS listed FROM listable
  UNION ALL SELECT n, key, n % 200 + 60, false FROM listable WHERE n % 3 < 2
  UNION ALL SELECT n, key, n % 200 + 150, true FROM listable WHERE n % 7 IN (1, 2, 3)),
spans AS (SELECT CASE WHEN n % 2 = 0 THEN 'ads' ELSE 'spam' END AS list, key, 'c' || CAST(n % 7 AS VARCHAR) AS category, listed,
  DATE '2024-01-01' + CAST(day AS INTEGER) AS valid_from, DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY n, key ORDER BY day) AS INTEGER) AS valid_to FROM entries),
base AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched FROM pages),
found AS (SELECT b.page_id, b.url, s.* FROM base b JOIN (SELECT page_id, url, unnest(keys) AS key FROM keyed) k ON k.page_id = b.page_id AND k.url = b.url
  JOIN spans s ON s.key = k.key AND s.listed AND b.fetched >= s.valid_from AND (s.valid_to IS NULL OR b.fetched < s.valid_to)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY page_id, url) AS n_entries, row_number() OVER (PARTITION BY page_id, url ORDER BY -length(key), key, list, category) AS r FROM found)
SELECT b.page_id, b.url, b.fetched, r.key IS NOT NULL AS blocked, coalesce(r.n_entries, 0) AS n_entries, r.key, r.list, r.category, r.valid_from
FROM base b LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.page_id = b.page_id AND r.url = b.url""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(text) AS th, {_WORDS.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS lines FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, source, th, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, source, th, unnest(lines) AS line FROM d)),
hosts AS (SELECT source, count(DISTINCT coalesce(th, '')) AS host_docs FROM d GROUP BY source),
bad AS (SELECT l.source, line FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source GROUP BY l.source, line, host_docs HAVING count(DISTINCT th) > 50 AND count(DISTINCT th) > 0.05 * host_docs),
removed AS (SELECT doc_id, sum(len({_WORDS.format("l.line")})) AS n FROM l JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM base""",
}
