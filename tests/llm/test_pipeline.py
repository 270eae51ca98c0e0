"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from cairn.llm import queries
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], SMALL)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def bag(t):
    w = words(t)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def normal(line):
    return " ".join(words(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def ruled(rows, min_docs, share):
    """What the quality rules keep, as the contract and the method say."""
    hosts, holders = {}, {}
    for _, t, _, source, _ in rows:
        hosts.setdefault(source, set()).add(t)
        for line in {normal(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((source, line), set()).add(t)
    bad = {k for k, v in holders.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for i, t, lang, source, n in rows:
        w = words(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {q for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        gone = [x for x in (t or "").split("\n") if (source, normal(x)) in bad]
        removed = sum(len(words(x)) for x in gone)
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and removed <= 0.5 * len(w):
            left = "\n".join(x for x in t.split("\n") if (source, normal(x)) not in bad)
            out.append((i, left, lang, source, len(left) if removed else n))
    return out


def mixed(rows):
    """Each row as often as the mix takes it: shares by weight, held to three times a source's size, round by round."""
    sizes = Counter()
    for _, t, _, source, _ in rows:
        sizes[source] += len(words(t))
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[x] for x in open_)
        over = {x for x in open_ if rest * weight[x] / total >= 3 * sizes[x]}
        if not over:
            target |= {x: rest * weight[x] / total for x in open_}
            break
        target |= {x: 3.0 * sizes[x] for x in over}
        rest -= sum(3 * sizes[x] for x in over)
        open_ -= over
    out = Counter()
    for r in rows:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        drawn = int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        out[r] += int(rate) + (drawn < rate - int(rate))
    return +out


def test_quality_stage_with_frequent_lines(spark):
    """Lines above the limits, copies of one text, and depleted documents."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(3_000)}" for _ in range(n))
    rows = [(i, f"Read  MORE here\n{prose(60)}\n{prose(8)}", "en", "h", 1) for i in range(70)] + [(100 + i, f"read more\there\n{prose(55)}", "en", "other", 1) for i in range(20)]
    rows += [(200 + i, "\n".join(["read more here"] * 30 + [prose(20)]), "en", "h", 1) for i in range(3)] + [(300 + i, "same text\n" + " ".join(f"c{k}" for k in range(60)), "en", "h", 1) for i in range(90)]
    rows += [(300, rows[-1][1], "en", "h", 1), (400, None, "en", "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.quality(spark, docs, "").collect()]
    want = ruled(rows, 50, 0.05)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(i >= 300 for i, *_ in got) == 91 and not any(200 <= i < 300 for i, *_ in got) and any(r[4] != 1 for r in got)


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in source.collect()] + [(None, None, None, None, None), (9001, "", "en", "s", 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, source.schema)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r)[:5] for r in docs.select(*columns).collect()]
        if name == "quality rules":
            assert sorted(map(str, after)) == sorted(map(str, ruled(before, 50, 0.05))) and len(after) < len(before)
        elif name == "minhash near-dedup":
            kept, bags = {r[0] for r in after}, {r[0]: bag(r[1]) for r in before}
            gone = {r[0] for r in before} - kept
            like = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
            assert gone and all(any(j != i and like(bags[i], bags[j]) for j in bags) for i in gone)
            ids = sorted(kept)
            assert not any(like(bags[i], bags[j]) for n, i in enumerate(ids) for j in ids[:n])
        elif name == "substring dedup":
            first = {}
            for i, t, *_ in sorted(before):
                w = words(t)
                for p in range(len(w) - 49):
                    first.setdefault(tuple(w[p : p + 50]), i)
            want = {}
            for i, t, *_ in before:
                w = words(t)
                hit = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
                if not hit or len(hit) < len(w):
                    want[i] = t if not hit else " ".join(x for q, x in enumerate(w) if q not in hit)
            assert {r[0]: r[1] for r in after} == want
            assert all(r[4] == len(r[1]) for r in after if r[1] != dict((b[0], b[1]) for b in before)[r[0]])
        elif name == "benchmark decontamination":
            lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            wins = {tuple(b[p : p + 10]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for b in [lower(r["text"])] for p in range(len(b) - 9)}
            clean = [r for r in before if not any(tuple(w[p : p + 10]) in wins for w in [lower(r[1])] for p in range(len(w) - 9))]
            assert sorted(after) == sorted(clean) and len(clean) < len(before)
        else:
            assert Counter(after) == mixed(before)


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 0
