"""Benchmark decontamination.

The benchmark's word windows are hashed and the set of hashes, 12 bytes each, is broadcast if their number is
within a bound, else Spark shuffles it. Every window of every training text is looked up by hash; what is found gets the
windows' words, which needn't be small, and is verified word by word against the text. Only hits are grouped by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import ascii_lower, free_names, set_aside, settled
from cairn.sources.tables import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Hashes of benchmark windows up to this number are broadcast, 48 MB of data.
BROADCAST_WINDOWS = 4_000_000
KEEP_SHARE = 0.0


def normal_words(text: Column) -> Column:
    """Words of a text after A-Z became a-z: runs of a-z, 0-9 and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _window_text(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _window_hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(length)])


def _starts(words: Column, length: int) -> Column:
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(length, window, hash, items)`` per distinct window; an item of fewer words is one window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    each = items.select("item_id", "w", length.alias("length"), F.explode(starts).alias("start"))
    each = each.select("item_id", "length", F.slice("w", F.col("start") + 1, F.col("length")).alias("w"))
    hashed = F.coalesce(*[F.when(F.col("length") == n, _window_hash(_word_hashes(F.col("w")), F.lit(0), n)) for n in range(1, window + 1)])
    grouped = each.groupBy("length", F.array_join("w", " ").alias("window"), hashed.alias("hash"))
    return grouped.agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """``(doc, body, hits)``: windows of documents whose hash is a benchmark window's, gathered by document and hash of its text."""
    base = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), _word_hashes(normal_words(F.col("text"))).alias("w"))

    def windows_of(n: int) -> Column:
        return F.transform(_starts(F.col("w"), n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), _window_hash(F.col("w"), i, n).alias("hash")))

    scanned = base.select("doc", "body", F.explode(F.concat(*map(windows_of, lengths))).alias("x")).select("doc", "body", "x.start", "x.length", "x.hash")
    hashes = windows.select("hash", "length").distinct()
    found = scanned.join(F.broadcast(hashes) if small else hashes, ["hash", "length"], "left_semi")
    return found.join(windows, ["hash", "length"]).groupBy("doc", "body").agg(F.collect_set(F.struct("start", "length", "window", "items")).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, item_ids`` and ``spans`` (start, length in words).

    A word is hit if it lies in any occurrence of a benchmark window. Null or empty texts have no
    words and no hits, an empty or null item no windows; repeated rows get equal results and an
    empty benchmark hits nothing. A very long text is one row like any other. Other columns pass through, those with these
    names are replaced. No rows give none.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "item_ids", "spans")
    doc, body, key, hits_of, listed = free_names(docs, "_doc", "_body", "_key", "_hits", "_w")
    windows = stored(benchmark_windows(benchmark, window), "windows")
    counts = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    none = F.array().cast("array<struct<start:int,length:int,window:string,items:array<bigint>>>")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    if counts:
        hits = _hits(docs, windows, sorted(counts), sum(counts.values()) <= broadcast_windows).withColumnsRenamed({"doc": doc, "body": body, "hits": hits_of})
        keyed = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col(key).eqNullSafe(F.col(body)), "left").drop(doc, body)
    else:
        keyed = keyed.withColumn(hits_of, none)
    keyed = keyed.withColumn(listed, normal_words(F.col("text")))  # after the join: words take more room than texts
    true = keyed.withColumn(hits_of, F.filter(F.coalesce(hits_of, none), lambda x: _window_text(F.col(listed), x["start"], x["length"]) == x["window"]))
    covered = F.array_distinct(F.flatten(F.transform(hits_of, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    figures = settled(true, {
        "n_words": F.size(listed).cast("long"),
        "n_hit": F.size(covered).cast("long"),
        "item_ids": F.array_distinct(F.flatten(F.col(hits_of)["items"])),
        "spans": F.array_sort(F.transform(hits_of, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))),
    })
    return figures.select(*docs.columns, "n_words", "n_hit", "item_ids", "spans").withColumn("n_items", F.size("item_ids").cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The documents whose share of hit words is at most ``keep_share``; by default any hit drops one."""
    docs, restored = set_aside(docs, ["n_words", "n_hit", "n_items", "item_ids", "spans"])
    checked = contamination(docs, benchmark, window)
    return restored(checked.where(F.col("n_hit") <= keep_share * F.col("n_words")).select(*docs.columns))
