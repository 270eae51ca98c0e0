"""Quality rules with cross-document line frequency.

Each text gets base figures (word characters, symbols, repeated lines, repeated three-word
windows) and the hashes of its normalised lines, in one scan whose result is stored without the texts unless they are
asked for. Then the documents with a line are counted per host, lines in too many are removed, and a
document of which too little is left is rejected.

Base figures stay in the row: windows are hashed and, in the texts that repeat one, sorted with their positions and
compared with their neighbours, so nothing is shuffled for them. Counts per line combine before the
shuffle; a hot host spreads over its lines and a hot line over the tasks that pre-count it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import BLANK_RUN, BLANKS, ascii_lower, free_names, words
from cairn.sources.tables import stored

SYMBOLS = r"[#*$%&|<>]"
#: A line is frequent in a host above this many documents and this share of them.
MIN_LINE_DOCS, LINE_SHARE = 50, 0.05
#: A document is depleted if frequent lines hold more than this share of its words.
MOST_REMOVED = 0.5
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    listed, hashes, windows, placed, again = free_names(docs, "_words", "_hashes", "_windows", "_placed", "_again")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    longs, ints = (F.array().cast(f"array<{t}>") for t in ("bigint", "int"))
    n = F.size(listed)
    first = docs.withColumn(listed, words(F.col("text"))).withColumn(hashes, F.transform(listed, lambda x: F.xxhash64(x)))
    h = lambda i: F.get(F.col(hashes), i)
    second = first.withColumn(windows, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(h(i), h(i + 1), h(i + 2)))).otherwise(longs))
    # only texts that have a window twice are looked at further
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.arrays_zip(F.col(windows).alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p"))
    third = second.withColumn(placed, F.when(repeats, F.sort_array(pairs)))
    at = lambda i: F.get(F.col(placed), i)["h"]
    beside = F.filter(placed, lambda x, i: (x["h"] == F.coalesce(at(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(at(i + 1), F.bitwise_not(x["h"]))))
    fourth = third.withColumn(again, F.coalesce(F.sort_array(F.transform(beside, lambda x: x["p"])), ints))
    p = lambda i: F.get(F.col(again), i)
    spans = F.transform(again, lambda x, i: F.least(F.lit(3), F.coalesce(p(i + 1) - x, F.lit(3))))
    figures = fourth.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(listed, "")).cast("long"),
        "n_symbols": (F.size(F.split(text, SYMBOLS)) - 1).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures.withColumn("base_failed", failed).select(*docs.columns, *FIGURES[:-1], "base_failed")


def normal_line(line: Column) -> Column:
    """A line in ASCII lower case with single blanks and none at its ends."""
    return F.btrim(F.regexp_replace(ascii_lower(line), BLANK_RUN, " "), F.lit(" "))


def line_hashes(text: Column) -> Column:
    """Of each line with a word its hash, normalised, and number of words; none for a null text."""
    single = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    full = F.filter(F.transform(F.split(single, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """``(host, line)`` of the lines in more than ``min_docs`` distinct documents of a host and ``share`` of them.

    ``lines`` has per row ``host, text`` (a hash) and ``lines``. Documents of one host and text are one document: copies and
    repeated rows are a matter for deduplication and don't make a line frequent. Null is a host of its own.
    """
    each = lines.select("host", "text", F.explode(F.array_distinct(F.col("lines")["line"])).alias("line"))
    # rows are at least as many as distinct texts, so that few lines are left to be counted exactly
    often = stored(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs).select(F.col("host").alias("at"), F.col("line").alias("often")), "often")
    some = each.join(often, F.col("host").eqNullSafe(F.col("at")) & (F.col("line") == F.col("often")), "left_semi").distinct()
    counted = some.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    hosts = lines.select(F.col("host").alias("source"), "text").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    above = counted.join(hosts, F.col("host").eqNullSafe(F.col("source"))).where(F.col("n") > share * F.col("host_docs"))
    return above.select("host", "line")


def quality_rules(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = LINE_SHARE, most_removed: float = MOST_REMOVED, texts: bool = True) -> DataFrame:
    """``docs`` with the base figures, ``n_removed_words`` (words in frequent lines), ``kept_text`` and ``kept``.

    ``kept_text`` is the text without its host's frequent lines, the other lines unchanged; without
    ``texts``, ``text`` and ``kept_text`` are left out. A null or empty text has no words and fails
    the base. Repeated rows get equal results and count once; a null doc_id is a key like any other, a null source a host. A very
    long text is one row like any other. Other columns pass through, those with the new names are replaced. No rows, no result.
    """
    docs = docs.drop(*FIGURES, "n_removed_words", "kept_text", "kept")
    lines, key, bad, *own = free_names(docs, "_lines", "_text", "_bad", "_id", "_key", "_host")
    kept_columns = [c for c in docs.columns if texts or c != "text"]
    measured = base_figures(docs.withColumns({key: F.xxhash64("text"), lines: line_hashes(F.col("text"))}))
    base = stored(measured.select(*kept_columns, key, lines, *FIGURES), "quality")
    of_lines = base.select(F.col("source").alias("host"), F.col(key).alias("text"), F.col(lines).alias("lines"))
    frequent = stored(frequent_lines(of_lines, min_docs, share), "frequent")
    each = base.select(F.col("doc_id").alias(own[0]), F.col(key).alias(own[1]), F.col("source").alias(own[2]), F.explode(F.col(lines)["line"]).alias("line_"))
    hit = each.join(frequent, (F.col("line_") == F.col("line")) & F.col(own[2]).eqNullSafe(F.col("host")), "left_semi")
    # a document's own frequent lines, at most as many as it has
    of_doc = hit.groupBy(*own).agg(F.collect_set("line_").alias(bad))
    joined = base.join(of_doc, F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col(key) == F.col(own[1])) & F.col("source").eqNullSafe(F.col(own[2])), "left")
    gone = F.aggregate(F.filter(lines, lambda x: F.array_contains(bad, x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = joined.withColumn("n_removed_words", F.when(F.col(bad).isNull(), F.lit(0).cast("long")).otherwise(gone))
    if texts:
        left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(bad, F.xxhash64(normal_line(x))))
        out = out.withColumn("kept_text", F.when(F.col(bad).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    kept = ~F.col("base_failed") & (F.col("n_removed_words") <= most_removed * F.col("n_words"))
    return out.withColumn("kept", kept).select(*kept_columns, *FIGURES, "n_removed_words", *["kept_text"] * texts, "kept")
