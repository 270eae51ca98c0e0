"""Columns with clashing names and empty tables, for every operator on documents and every stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bagminhash, decontamination, language_id, mixing, quality_rules, substring_dedup, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HELPERS = [
    "_id", "_text", "_host", "_key", "_hits", "_w", "_one", "_whole", "_doc", "_body", "_source", "_lines", "_words", "_windows", "_again", "_bad", "_hashes", "_placed",
    "_aside_0", "_hash", "_bin", "marks", "whole", "copied", "seed", "body", "line", "lines", "host", "hash", "length", "window", "items", "sha", "first", "digest", "key", "bag", "class", "nth", "part",
]
RESULTS = ["kept", "kept_text", "n_removed_words", "size", "source_size", "target", "copies", "n_hit", "n_items", "item_ids", "spans", "n_words", "n_removed", "class_id", "class_size", "score", "predicted"]


def some_docs(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared, text = prose(70), prose(120)
    rows = [(i, prose(90), "en", "a", 1) for i in range(5)] + [(10, f"{prose(40)} {shared}", "en", "b", 1), (11, f"{shared} {prose(40)}", "de", None, 1)]
    rows += [(20, text, "en", "a", 1), (21, text, "en", "a", 1), (21, text, "en", "a", 1), (30, None, None, None, None), (31, "", "en", "a", 0), (None, prose(60), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df, names):
    return df.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names])


def carried(rows, names):
    return all(r[n] == f"{n} of {'null' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("benchmark"))
    text = " ".join(some_docs(spark).where("doc_id = 3").first()["text"].split()[5:30])
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, benchmark_dir, name, stage):
    plain = some_docs(spark)
    names = [*HELPERS, *RESULTS]
    wide = clashing(plain, names)
    before = sorted(map(str, stage(spark, plain, benchmark_dir).select(*plain.columns).collect()))
    got = stage(spark, wide, benchmark_dir)
    assert got.columns[: len(wide.columns)] == wide.columns and set(got.columns) - set(wide.columns) <= {"copy"}
    assert sorted(map(str, got.select(*plain.columns).collect())) == before and before
    assert carried(got.collect(), names)
    empty = stage(spark, wide.limit(0), benchmark_dir)
    assert empty.columns == got.columns and empty.count() == 0


def test_operators(spark, benchmark_dir):
    plain = some_docs(spark)
    bench = spark.read.parquet(f"{benchmark_dir}/benchmark.parquet")
    labels = plain.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    keyed = plain.withColumn("key", F.col("doc_id"))
    model, distance = language_id.fit(keyed), toxicity.fit(keyed.select("key", "text"), labels)
    operators = {
        "quality": (quality_rules.quality_rules, [*quality_rules.FIGURES, "n_removed_words", "kept_text", "kept"]),
        "mixing": (mixing.mix_plan, ["size", "source_size", "target", "copies"]),
        "contamination": (lambda d: decontamination.contamination(d, bench), ["n_words", "n_hit", "n_items", "item_ids", "spans"]),
        "substrings": (substring_dedup.remove_repeats, ["n_words", "n_removed", "spans", "kept_text"]),
        "language": (lambda d: language_id.identify(d, model), ["lang_pred", "score", "rejected"]),
        "toxicity": (lambda d: toxicity.score(d, distance), ["score", "predicted"]),
    }
    for name, (run, made) in operators.items():
        names = [n for n in [*HELPERS, *RESULTS] if n not in made]
        got = run(clashing(plain, names)).collect()
        assert sorted(str([r[k] for k in ("doc_id", *made)]) for r in got) == sorted(str([r[k] for k in ("doc_id", *made)]) for r in run(plain).collect()), name
        assert len(got) == plain.count() and carried(got, names), name
        assert run(clashing(plain, names).limit(0)).count() == 0, name


def test_operators_that_leave_columns_out(spark):
    wide = clashing(some_docs(spark), [*HELPERS, *RESULTS])
    for run in (suffix_dedup.remove_repeats, bagminhash.near_duplicates):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(some_docs(spark)).collect()))
        assert run(wide.limit(0)).count() == 0
