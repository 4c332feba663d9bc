"""Ranked lexical search and source divergence against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm.divergence import divergence, scaled
from lumenspan.llm.lexical_search import Scale, forward_index, item_terms, lengths, plan, ranked_search, term_bounds, weights

A_Z = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(A_Z))


def plain_search(docs, items, k):
    """docs: (id, text) rows; items: (id, text) rows."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    of = defaultdict(set)
    for i, t in items:
        of[i] |= set(terms(t))
    out = []
    for i, wanted in of.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "漢字", "the", "The"]
    zipf = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, zipf, k=rng.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (None, None), (n + 1, ""), (n + 2, "w0 " * 30_000)] + [(n + 10 + k, docs[11][1] + " w250") for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 40])))) for k in range(30)] + [(0, "w250 again"), (None, "w3 w5-W7"), (50, None), (51, "nowhere"), (52, "w0")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, "clash", 3, [1]) for r in docs], "doc_id long, text string, term string, id int, ids array<int>").repartition(5)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return d, i


@pytest.mark.parametrize("k, block", [(50, 400_000), (5, 60)])
def test_search_is_the_brute_force_one(spark, k, block):
    docs, items = corpus(1)
    d, i = frames(spark, docs, items)
    got = sorted((tuple(r) for r in ranked_search(d, i, k, block=block).collect()), key=str)
    assert got == sorted(plain_search(docs, items, k), key=str)


def test_thresholds_hold_and_prune(spark):
    """No item's threshold is above its kth score, and frequent terms are pruned from the search for candidates."""
    docs, items = corpus(2)
    d, i = frames(spark, docs, items)
    pairs = [(r.item, r.term.encode()) for r in item_terms(i).collect()]
    known = {t: k for k, t in enumerate(sorted({t for _, t in pairs}))}
    index = forward_index(d.select(F.col("doc_id").alias("id"), "text"), known).cache()
    rows = index.collect()
    n, total = sum(r.n > 0 for r in rows), sum(r.n for r in rows)
    df = Counter(t for r in rows for t in r.ids)
    scale = Scale(n, total, weights(np.array([df[t] for t in range(len(known))]), n))
    kth, top = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    for r in term_bounds(index, scale, 5).collect():
        kth[r.term], top[r.term] = r.kth or 0, r.top
    found = plan([(a, known[t]) for a, t in pairs], len(known), kth, top)
    want = defaultdict(list)
    for a, _, _, score in plain_search(docs, items, 5):
        want[a].append(score)
    for a, least in zip(found.ids, found.least):
        assert len(want[a]) < 5 or least <= want[a][4]
    assert len(found.scoring[1]) > 20 and (found.pruned < found.least).all()


def test_search_in_empty_tables(spark):
    docs, items = corpus(3, 20)
    d, i = frames(spark, docs, items)
    assert ranked_search(d.where("false"), i).count() == 0
    assert ranked_search(d, i.where("false")).count() == 0


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9], np.int64)
    assert lengths(n, 10**10, 10**13).tolist() == [50 + 50 * int(x) * 10**10 // 10**13 for x in n]
    assert lengths(n[:1], 0, 0).tolist() == [50]


def plain_divergence(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(A_Z))
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(r[2], Counter(words(r[0]))) for r in rows if r[1] == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = [t for t in df if df[t] >= min_docs]
        counts = {s: Counter() for s, _ in mine}
        for s, c in mine:
            counts[s].update({t: c[t] for t in kept if t in c})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        of, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum(f(of[s][t], of[o][t]) for t in kept)) for o in counts if o != s]
            own = [(t, f(of[s][t], q[t])) for t in kept if counts[s][t] and of[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(ranked[:most])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_the_brute_force_one(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "漢字", "Ω", "ab-cd", "x1y"]
    zipf = [1 / (k + 1) for k in range(len(words))]
    rows = [(" ".join(rng.choices(words, zipf, k=rng.choice([0, 3, 60]))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", "é", "", None])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("only one", "fr", "a"), ("", "fr", "b"), ("w " * 20_000, "en", "s1"), *rows[:5], (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = sorted(tuple(r) for r in divergence(df, min_docs=5, top=4).collect())
    assert got == sorted(plain_divergence(rows, 5, 4))


def test_divergence_of_an_empty_table(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_quotients_are_exact(spark):
    count = np.array([0, 2, 5 * 10**14, 8 * 10**15 - 1, 8 * 10**15], np.int64)
    total = 8 * 10**15
    want = [1 + 10**9 * int(c) // total for c in count]
    assert scaled(count, np.int64(total)).tolist() == want
    df = spark.createDataFrame([(int(c), total) for c in count], "c long, t long")
    assert [r.p for r in df.select(scaled(F.col("c"), F.col("t")).alias("p")).collect()] == want
