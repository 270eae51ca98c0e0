"""Defined results for nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bagminhash, decontamination, hashing, language_id, mixing, quality_rules, repeats, substring_dedup, suffix_dedup, toxicity, url_filters, warc
from cairn.sources.tables import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, empty and long texts, copies, repeated rows, one id with two texts."""
    rng = random.Random(1)
    long = prose(rng, 30_000, 5_000)
    shared = prose(rng, 90)
    rows = [(i, prose(rng, 80), "en", "a") for i in range(6)]
    rows += [(10, f"{prose(rng, 30)} {shared} {prose(rng, 30)}", "de", "b"), (11, f"{prose(rng, 20)} {shared}", "de", None), (12, shared, None, "b")]
    rows += [(20, long, "en", "a"), (21, long, "en", "a"), (21, long, "en", "a")]
    rows += [(30, None, None, None), (31, "", "en", "a"), (32, " \n\t ", "en", "a"), (33, "é", "fr", "a"), (34, "!?", "fr", "a"), (None, shared, "en", "a"), (None, None, None, None)]
    rows += [(40, prose(rng, 60), "en", "c"), (40, f"{shared} tail", "en", "c")]
    return rows


def test_mixing(spark, odd):
    df = docs(spark, odd).withColumn("size", F.lit("clash"))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(odd)
    again = mixing.mix_plan(df.repartition(3)).collect()
    key = lambda r: str((r["doc_id"], r["text"], r["copies"]))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    targets = {r["source"]: (r["source_size"], r["target"]) for r in plan}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(n for n, _ in targets.values()))
    assert all(t <= 3 * n for n, t in targets.values()) and all(r["copies"] <= 3 for r in plan)
    assert mixing.mix_sources(df).count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_mixing_targets(spark):
    got = mixing.source_targets(spark.createDataFrame([("a", 100), ("b", 1000), ("c", 0), (None, 900)], "source string, size long"))
    found = {r["source"]: r["target"] for r in got.collect()}
    # a is held at 300; the rest, 1700, goes by 2 and 5 to b and null
    assert found == {"a": 300.0, "b": pytest.approx(1700 * 2 / 7), "c": 0.0, None: pytest.approx(1700 * 5 / 7)}


def test_quality(spark, odd):
    df = docs(spark, odd).withColumn("kept", F.lit("clash"))
    rows = quality_rules.quality_rules(df).collect()
    assert len(rows) == len(odd)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        tri = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {p for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(words), len(hit), sum(map(len, words)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_frequent_lines(spark):
    rng = random.Random(2)
    rows = [(i, f"Menu  HOME\n{prose(rng, 60)}", "en", "h") for i in range(30)] + [(99, "\n".join(["menu home"] * 60) + "\nx y z", "en", "h"), (100, f"menu home\n{prose(rng, 60)}", "en", "other")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows), min_docs=10, share=0.1).collect()}
    assert got[0]["n_removed_words"] == 2 and got[0]["kept"]
    assert got[99]["n_removed_words"] == 120 and not got[99]["kept"]
    assert got[100]["n_removed_words"] == 0
    twice = docs(spark, rows[:30] + rows[:1])
    assert {r["n_removed_words"] for r in quality_rules.quality_rules(twice, min_docs=10, share=0.1).collect()} == {2}


def test_frequent_lines_are_removed(spark):
    rng = random.Random(21)
    body = [f"{prose(rng, 60)}\n\n  {prose(rng, 9)} " for _ in range(60)]
    rows = [(i, f"Menu \t HOME\n{b}\nmenu home", "en", "h") for i, b in enumerate(body)]
    rows += [(100, f"menu home\n{body[0]}", "en", "other"), (101, f"{prose(rng, 60)}", "en", "h"), (102, None, "en", "h")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows).withColumn("kept_text", F.lit("clash"))).collect()}
    want = dict(enumerate(body)) | {i: t for i, t, *_ in rows[60:]}
    assert {i: r["kept_text"] for i, r in got.items()} == want
    assert all(r["n_removed_words"] == r["n_words"] - len((r["kept_text"] or "").split()) for r in got.values())
    after = {r["doc_id"]: r for r in corpus_pipeline.quality(spark, docs(spark, rows), "").collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in after.items()} == {i: (t, len(t)) for i, t in want.items() if t}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_decontamination(spark, odd, limit):
    rng = random.Random(3)
    bench = [(1, " ".join((odd[6][1] or "").split()[35:60]).upper()), (2, "é"), (3, None), (4, ""), (5, prose(rng, 40)), (6, "Tail")]
    df = docs(spark, odd).withColumn("spans", F.lit("clash"))
    rows = decontamination.contamination(df, spark.createDataFrame(bench, "item_id long, text string"), broadcast_windows=limit).collect()
    assert len(rows) == len(odd)

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    for r in rows:
        w, hit, items = words(r["text"]), set(), set()
        for i, t in bench:
            b = words(t)
            n = min(10, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items.add(i)
        assert (r["n_words"], r["n_hit"], sorted(r["item_ids"])) == (len(w), len(hit), sorted(items))
    none = decontamination.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(odd)
    assert decontamination.contamination(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def removed(items, rows, n):
    first = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - n + 1):
                key = tuple(t[k : k + n])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - n + 1) if i is not None else ():
            if first[tuple(t[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, gone))
    return out


def test_substring_dedup(spark, odd):
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in odd]
    want = sorted(str((i, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y))) for (i, w), (_, g) in zip(rows, removed(None, rows, 50), strict=True))
    df = docs(spark, odd).withColumn("marks", F.lit("clash"))
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])) for r in got) == want
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_longest_repeats(spark):
    rng = random.Random(8)
    a, b = prose(rng, 230, 9_000), prose(rng, 60, 9_000)
    rows = [(1, a, "en", "s"), (2, f"x {a} y", "en", "s"), (3, b, "en", "s"), (4, f"{b} z", "en", "s"), (5, prose(rng, 300, 9_000), "en", "s")]
    assert {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(docs(spark, rows)).collect()} == {2: 200, 4: 50}


def test_suffix_dedup(spark, odd):
    rng = random.Random(4)
    small = [(i, (t or "")[:700], x, y) if t else (i, t, x, y) for i, t, x, y in odd] + [(60 + i, "ab" * rng.randrange(60) + "é" * rng.randrange(40), "en", "a") for i in range(8)]
    rows = [(i, (t or "").encode()) for i, t, _, _ in small]
    want = []
    for (i, w), (_, g) in zip(rows, removed(None, rows, 50), strict=True):
        want.append(str((i, len(w), sum(g), len(re.findall("1+", "".join("01"[x] for x in g))), bytes(x for x, y in zip(w, g, strict=True) if not y))))
    got = suffix_dedup.remove_repeats(docs(spark, small)).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]))) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(docs(spark, small).limit(0)).count() == 0


def test_repeats_of_a_seed_in_many_bundles(spark, monkeypatch):
    """A passage with different neighbours each time, copies and an id with two texts; compared together, and by window."""
    rng = random.Random(12)
    passage = prose(rng, 70, 9_000)
    rows = [(i, f"{prose(rng, 30, 9_000)} {passage} {prose(rng, 30, 9_000)}", "en", "s") for i in range(12)]
    rows += [(20, rows[3][1], "en", "s"), (2, rows[3][1], "en", "s"), (21, prose(rng, 80, 9_000), "en", "s"), (22, "short", "en", "s"), (23, "short", "en", "s")]
    words = [(i, t.split()) for i, t, _, _ in rows]
    want = sorted((i, sum(g)) for i, g in removed(None, words, 50))
    for most in (repeats.TOGETHER, 2):
        monkeypatch.setattr(repeats, "TOGETHER", most)
        assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()) == want
    longest = {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(docs(spark, rows)).collect()}
    assert longest == {i: 100 if i in (3, 20) else 50 for i in (*range(1, 12), 20)}


def test_seeds_follow_content():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    shape = repeats.Shape(50, 28, 5)
    a, b = repeats.bundles(s, shape), repeats.bundles(s[333:700], shape)
    inside = {(int(x), int(y)) for x, y in zip(a.seed, a.text, strict=True)}
    assert sum((int(x), int(y)) in inside for x, y in zip(b.seed, b.text, strict=True)) >= len(b.seed) - 2
    assert a.count.sum() == 851 and a.count.max() <= 64
    assert len(repeats.bundles(s[:49], shape).first) == 0


def test_near_duplicates(spark, odd):
    rng = random.Random(5)
    base = prose(rng, 200, 5_000).split()
    near = [(100 + k, " ".join(w if i != 20 * k + 7 else "other" for i, w in enumerate(base)), "en", "n") for k in range(8)]
    rows = odd + [(99, " ".join(base), "en", "n")] + near
    got = bagminhash.near_duplicates(docs(spark, rows).withColumn("class_id", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got}
    assert all(by[i] == (99, 9) for i in range(99, 108))
    assert by[21] == (20, 3) and by[None] == (None, 1) and by[30][0] == 30 and by[0] == (0, 1)
    assert bagminhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def by_brute_force(texts):
    """Class per id: the least id that links of similarity 0.8 lead to, all pairs compared."""
    ids = sorted(texts)
    bags = {i: bagminhash.expanded(hashing.shingles(hashing.words_of(texts[i]), 5)) for i in ids}
    of = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if of[i] != of[j] and bagminhash.overlap(bags[i], bags[j]) >= 0.8:
                low, high = sorted((of[i], of[j]))
                of = {k: low if c == high else c for k, c in of.items()}
    return of


def changed(rng, text, at):
    w = text.split()
    for p in at:
        w[p] = f"c{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("paired", [0, bagminhash.PAIRED])
def test_near_duplicates_among_templates(spark, monkeypatch, paired):
    """Many texts like a template but below the limit, and a few pairs of them above it."""
    monkeypatch.setattr(bagminhash, "PAIRED", paired)
    monkeypatch.setattr(bagminhash, "BLOCK", 40)
    rng = random.Random(11)
    template = prose(rng, 300, 5_000)
    texts = {}
    for i in range(0, 600, 2):
        at = rng.sample(range(300), 8)
        base = changed(rng, template, at[:3])
        texts[i] = changed(rng, base, at[3:5])
        if i < 20:
            texts[i + 1] = changed(rng, base, at[5:8])
    want = by_brute_force(texts)
    got = bagminhash.near_duplicates(docs(spark, [(i, t, "en", "n") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(want[i + 1] == want[i] for i in range(0, 20, 2)) and len(set(want.values())) > 200


@pytest.mark.parametrize("paired", [0, bagminhash.PAIRED])
def test_near_duplicates_over_several_leaders(spark, monkeypatch, paired):
    """Chains of versions each near the next only, and groups whose members link to one of two leaders."""
    monkeypatch.setattr(bagminhash, "PAIRED", paired)
    rng = random.Random(12)
    texts = {}
    for c in range(20):
        text = prose(rng, 300, 5_000)
        order = rng.sample(range(300), 300)
        for k in range(8):
            texts[100 * c + k] = text
            text = changed(rng, text, order[4 * k : 4 * k + 4])
    for c in range(20, 40):
        # x and y link to each other, and each to the leader on its side, which copies of its own make the leader
        x = prose(rng, 300, 5_000)
        order = rng.sample(range(300), 300)
        y = changed(rng, x, order[:4])
        left, right = changed(rng, x, order[4:8]), changed(rng, y, order[8:12])
        for k, t in enumerate([x, y, left, right]):
            texts[100 * c + k] = t
        for k in range(4):
            texts[100 * c + 10 + k] = changed(rng, left, [order[20 + k]])
            texts[100 * c + 20 + k] = changed(rng, right, [order[30 + k]])
    want = by_brute_force(texts)
    got = bagminhash.near_duplicates(docs(spark, [(i, t, "en", "n") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = np.repeat(x[:220], 3), np.repeat(x[60:], 5)
    want = bagminhash.overlap(bagminhash.expanded(a), bagminhash.expanded(b))
    got = []
    for k in range(20):
        s = bagminhash.signatures([hashing.mix(a, k), hashing.mix(b, k)], 100)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.04


def test_warc(spark):
    rng = random.Random(6)
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\nWARC/1.1"
    pages = [(1, "http://a/x\r\ny", prose(rng, 30_000)), (2, None, None), (3, "http://b", ""), (4, "http://c", tricky * 300), (5, "http://d", "é" * 9_000), (6, "http://e", "same"), (7, "http://f", "same"), (8, "http://g", "same"), (8, "http://g", "same"), (9, "http://h", prose(rng, 20_000)), (9, "http://h", "other"), (None, "http://i", "none")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    path = shared_path(spark, "warc-test")
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path).collect()
    latest = {}
    for i, _, h in pages:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = latest.get(h or "") if i is not None and latest[h or ""] > i else None
        want.append(str((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if to else "response", to, True)))
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["complete"])) for r in got) == sorted(want)
    kept = Counter(bytes(r["payload"]) for r in got if r["record_type"] == "response")
    assert kept[pages[0][2].encode()] == 1 and kept[(tricky * 300).encode()] == 1
    segments = warc.read_segments(spark, path)
    assert segments.where("segment > 1").count() > 2
    broken = warc.reassemble(segments.where("segment <> 2")).collect()
    assert broken and not any(r["complete"] for r in broken)
    ids = [r["record_id"] for r in warc.read_records(spark, path).collect()]
    assert len(set(ids)) == len(ids)
    empty = shared_path(spark, "warc-empty")
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_chunked():
    for text in ("", "a", "x" * 10_000, "é" * 5_000, warc.VERSION * 50):
        framed = warc.encode_chunked(text, 7)
        assert warc.decode_chunked(framed.encode()) == text.encode()
    assert warc.decode_chunked(b"5\r\nab") is None and warc.decode_chunked(b"zz\r\n") is None


def test_language(spark):
    rng = random.Random(7)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60))
    kinds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"]}
    rows = [(i, make(kinds[k]), k, "s") for i, k in enumerate(["aa", "bb"] * 30)]
    model = language_id.fit(docs(spark, rows).withColumnRenamed("doc_id", "key"))
    test = [(i, make(kinds[k]), k, "s") for i, k in enumerate(["aa", "bb"] * 10)] + [(90, None, "aa", "s"), (91, "123 !?", "aa", "s"), (92, "", None, None), (93, "д" * 400, "aa", None)]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, test).withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in test[:20])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92))
    assert got[93]["rejected"] and 0 <= got[93]["score"] <= 1
    none = language_id.fit(docs(spark, rows).limit(0).withColumnRenamed("doc_id", "key"))
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, test), none).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["gruntok", "blarfen", "snikwit"]
    rows, labels = [], []
    for i in range(240):
        w = prose(rng, 120).split()
        if i % 3 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    keyed = spark.createDataFrame(rows, "key long, text string")
    model = toxicity.fit(keyed, spark.createDataFrame(labels + [(None, 1), (5, None), (6, 7)], "key long, toxic int"))
    test = spark.createDataFrame([(1, prose(rng, 300) + " gruntok blarfen " + prose(rng, 300)), (2, prose(rng, 600)), (3, None), (4, ""), (4, ""), (None, "a")], "doc_id long, text string")
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(test, model).collect()]
    by = {i: p for i, _, p in got}
    assert len(got) == 6 and by[1] == 1 and by[2] == by[3] == by[4] == by[None] == 0
    assert all(0 <= s <= 1 for _, s, _ in got)
    nothing = toxicity.fit(keyed.limit(0), spark.createDataFrame([], "key long, toxic int"))
    assert {r["score"] for r in toxicity.score(test, nothing).collect()} == {0.0}


def test_url_filters(spark):
    entries = spark.createDataFrame([("ads", "x.com", "c1", "2024-01-10", True), ("ads", "x.com", None, "2024-02-01", False), ("ads", "x.com", "c2", "2024-03-01", True), ("spam", "b.org/p", "c3", "2023-05-01", True), ("spam", None, "c", "2024-01-01", True), ("spam", "y.com", "c", None, True)],
                                    "list string, key string, category string, dated string, listed boolean").withColumn("dated", F.col("dated").cast("date"))
    rows = [(1, "http://a.x.com/q", "2024-01-09"), (2, "http://a.x.com/q", "2024-01-10"), (3, "https://u:p@X.COM:80/", "2024-01-31"), (4, "http://x.com", "2024-02-01"), (5, "http://x.com", "2030-01-01"), (6, "http://b.org/p/q?x", "2024-01-01"), (7, "http://b.org/pq", "2024-01-01"), (8, None, "2024-01-01"), (9, "nonsense", "2024-01-01"), (10, "http://x.com", None), (10, "http://x.com", None), (None, "http://x.com", "2024-01-15")]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("key", F.lit("clash"))
    got = {r["page_id"]: (r["blocked"], r["category"], r["n_entries"]) for r in url_filters.filter_urls(df, entries).collect()}
    hit = lambda c: (True, c, 1)
    no = (False, None, 0)
    assert got == {1: no, 2: hit("c1"), 3: hit("c1"), 4: no, 5: hit("c2"), 6: hit("c3"), 7: no, 8: no, 9: no, 10: no, None: hit("c1")}
    assert url_filters.filter_urls(df, entries.limit(0)).where("blocked").count() == 0
    deep = spark.createDataFrame([("ads", "h.com/a/b/c/d", "c"), ("ads", "3.4", "c"), ("ads", "1.2.3.4", "ip"), ("ads", "[::1]", "six")], "list string, key string, category string").withColumns({"dated": F.lit("2020-01-01").cast("date"), "listed": F.lit(True)})
    urls = ["http://h.com/a/b/c/d/e", "http://h.com/a/b/c", "http://1.2.3.4/x", "http://5.2.3.4/x", "http://u@[::1]:80/", "http://h.com/" + "p/" * 20_000]
    asked = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("fetched", F.lit("2024-01-01").cast("date"))
    assert {r["page_id"]: r["key"] for r in url_filters.filter_urls(asked, deep).collect()} == {0: "h.com/a/b/c/d", 1: None, 2: "1.2.3.4", 3: None, 4: "[::1]", 5: None}
    many = spark.range(3_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.com/"), "id").alias("url"), F.lit("2024-01-20").cast("date").alias("fetched"))
    assert url_filters.filter_urls(many, entries).where("blocked and n_entries = 1").count() == 3_000
    assert url_filters.filter_urls(df.limit(0), entries).count() == 0


def test_long_texts():
    for text in ("x" * 600_000 + " y z", "é " * 300_000):
        words = hashing.words_of(text)
        assert len(words) == len(text.split()) and len(np.unique(words)) == len(set(text.split()))


def test_classifiers_on_very_long_texts(spark):
    """A text of more bytes than are hashed at once, and toxic words at the end of a long one."""
    rng = random.Random(17)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"]}
    model = language_id.fit(docs(spark, [(i, make(kinds[k], 60), k, "s") for i, k in enumerate(["aa", "bb"] * 20)]).withColumnRenamed("doc_id", "key"))
    long = make(kinds["bb"], 120_000)
    assert len(long) > language_id.BLOCK
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, [(1, long, None, None), (2, long, None, None), (3, "½ ② Ⅷ", None, None), (4, "1 !" * 500_000, None, None)]), model).collect()}
    assert got == {1: "bb", 2: "bb", 3: "und", 4: "und"}
    bad = ["gruntok", "blarfen", "snikwit"]
    rows = [(i, " ".join([prose(rng, 100), *([rng.choice(bad) for _ in range(6)] if i % 3 == 0 else []), prose(rng, 20)])) for i in range(240)]
    distance = toxicity.fit(spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "key long, toxic int"))
    texts = [(1, prose(rng, 150_000) + " " + " ".join(bad * 3)), (2, prose(rng, 150_000))]
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), distance).collect()} == {1: 1, 2: 0}
