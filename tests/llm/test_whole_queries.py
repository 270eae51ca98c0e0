"""The queries that SQL can't express, over whole tables: against brute force, or by held-out quality."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cairn.llm import bagminhash, hashing, queries, substring_dedup, suffix_dedup

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def removed(rows, n):
    """Of (id, sequence of hashable slices) which symbols a window covers that also starts at a smaller id."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - n + 1):
            key = t[k : k + n] if isinstance(t, bytes) else tuple(t[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if first[t[k : k + n] if isinstance(t, bytes) else tuple(t[k : k + n])] < i:
                gone[k : k + n] = True
        out.append((i, t, gone))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_substring_query(spark):
    want = [(i, len(t), int(g.sum()), sha(" ".join(x for x, y in zip(t, g, strict=True) if not y).encode())) for i, t, g in removed([(r["doc_id"], words(r["text"])) for r in table(spark, SMALL, "documents")], 50)]
    got = queries.QUERIES["op2_substring_dedup"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert any(w[2] for w in want)


def test_suffix_query(spark):
    def row(i, t, g):
        return i, len(t), int(g.sum()), int((np.diff(np.concatenate(([False], g)).astype(int)) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~g].tobytes())

    want = [row(*x) for x in removed([(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, SMALL, "documents")], 50)]
    got = queries.QUERIES["op6_suffix_dedup"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert any(w[2] for w in want)


def test_texts_above_a_piece(spark):
    """Texts of more symbols than are worked through at once share passages over the borders of the pieces."""
    rng = random.Random(31)
    vocabulary = [f"v{k}" for k in range(40_000)]
    a = [rng.choice(vocabulary) for _ in range(hashing.PIECE + 9_000)]
    b = [rng.choice(vocabulary) for _ in range(200)] + a[hashing.PIECE - 4_000 : hashing.PIECE + 4_000] + ["x"] * 300 + a[:60]
    c = b[3_000:6_000] + ["y"] + a[hashing.PIECE - 90 : hashing.PIECE + 70]
    texts = [(1, a), (2, b), (3, c)]
    want = {i: int(g.sum()) for i, _, g in removed(texts, 50)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()} == want and want[2] > 8_000
    raw = "".join(rng.choice("abcdé ") for _ in range(hashing.PIECE * 2))
    near = int(hashing.PIECE * 0.9)
    second = "q" * 70 + raw[near - 40_000 : near + 60_000] + "z" * 400 + raw[100:180]
    texts = [(1, raw.encode()), (2, second.encode()), (3, ("z" * 60 + second[:90]).encode())]
    want = {i: (len(t), int(g.sum())) for i, t, g in removed(texts, 50)}
    df = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()} == want


def test_near_duplicates_query(spark):
    """Recall and precision over all pairs of the documents, by comparing all of them."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, MEDIUM, "documents")}
    bags = {i: bagminhash.expanded(hashing.shingles(hashing.words_of(t), 5)) for i, t in docs.items()}
    ids = [i for i in sorted(docs) if len(bags[i])]
    links = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if 0.8 <= len(bags[i]) / len(bags[j]) <= 1.25 and bagminhash.overlap(bags[i], bags[j]) >= 0.8]
    of = {i: i for i in docs}
    for i, j in links:
        if of[i] != of[j]:
            low, high = sorted((of[i], of[j]))
            of = {k: low if c == high else c for k, c in of.items()}
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op4_bagminhash"](spark, MEDIUM).collect()}
    assert set(got) == set(docs)
    found = sum(got[i] == got[j] for i, j in links)
    assert links and found >= 0.99 * len(links)
    assert all(of[i] == of[got[i]] for i in docs)


def test_language_query(spark):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, MEDIUM, "documents")}
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_language_id"](spark, MEDIUM).collect()}
    assert set(got) == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, lang[i][1] or ""))) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and lang[i][0] and r["lang_pred"] != "und"]
    assert np.mean([got[i]["lang_pred"] == lang[i][0] for i in held]) >= 0.98


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_toxicity_query(spark, sf):
    label = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels")}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(r["score"], label[i]) for i, r in got.items() if r["held_out"] and label.get(i) in (0, 1)]
    ones, zeros = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    auc = np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))
    assert auc >= 0.92 and np.mean(ones >= 0.3) >= 0.8 and np.mean(zeros < 0.3) >= 0.95


def test_labels_of_held_out_rows_are_not_learned(spark, tmp_path):
    """Other labels and languages of held-out rows leave all results as they are."""
    from pyspark.sql import functions as F

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{n}.parquet") for n in ("documents", "labels"))
    docs.withColumn("lang", F.when(crc % 3 == 1, "xx").otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(crc % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op8_language_id", "op10_toxicity"):
        rows = [sorted(map(str, queries.QUERIES[name](spark, sf).collect())) for sf in (MEDIUM, str(tmp_path))]
        assert rows[0] == rows[1]


def test_prefix_doubling(spark):
    """The method as dealt, over all positions, covers the bytes that the operator removes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    gone = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for r in suffix_dedup.doubled_repeats(docs).collect():
        gone[r["doc_id"]][r["start"] : r["start"] + 50] = True
    want = {i: int(g.sum()) for i, _, g in removed(list(texts.items()), 50)}
    assert {i: int(g.sum()) for i, g in gone.items()} == want and any(want.values())
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == want
