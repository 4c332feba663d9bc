"""Operators over many texts, against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import induced_sort, jaccard_join, packing, pitman_yor, seating, suffix_dedup, warc
from lumenspan.llm.components import components
from lumenspan.llm.util import run_dir

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# 2 ------------------------------------------------------------------------------------------------------------------
def test_a_shard_far_larger_than_memory_is_sorted_by_names(monkeypatch):
    """Queues of 20 kB for a text of 60 kB and its tuples: blocks are written to the scratch file, and the order is right."""
    spilled = []
    put = induced_sort.Spool.put

    def counted(self, *arrays):
        block = put(self, *arrays)
        spilled.append(len(block) == 3)
        return block

    monkeypatch.setattr(induced_sort.Spool, "put", counted)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 101, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(200)]
    t = np.frombuffer(b" ".join(words[int(k)] for k in rng.integers(0, 200, 11_000)) + b"\0", np.uint8)
    got = np.concatenate([p for p, _ in induced_sort.sorted_suffixes(t, 50, memory=20_000, names=True)])
    raw = t.tobytes() + bytes(60)
    assert [raw[p : p + 50] for p in got] == sorted((raw[p : p + 50] for p in range(len(t))), reverse=True)
    assert sum(spilled) > 100


@pytest.mark.parametrize("names", [False, True])
def test_induced_sorting_equals_sorting(names):
    rng = np.random.default_rng(3)
    for trial in range(150):
        n, k = int(rng.integers(1, 120)), int(rng.integers(1, 5))
        t = rng.integers(1 if trial % 3 else 0, k + 1, n).astype(np.uint8)
        t[-1] = 0
        depth = int(rng.choice([5, 8, 50]))
        got = [(int(p), int(v)) for a, b in induced_sort.sorted_suffixes(t, depth, memory=int(rng.choice([64, 10**6])), names=names) for p, v in zip(a, b)]
        raw = t.tobytes() + bytes(depth + 8)
        assert sorted(p for p, _ in got) == list(range(n))
        for (p, _), (q, v) in itertools.pairwise(got):
            x, y = raw[p : p + depth], raw[q : q + depth]
            same = next((i for i in range(depth) if x[i] != y[i]), depth)
            assert y <= x and (v == same or max(p, q) + min(v, same) >= n - 1)


def removed_by_hand(rows, w=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            if d is not None:
                first[b[i : i + w]] = min(d, first.get(b[i : i + w], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if d is not None and first[b[i : i + w]] < d:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return Counter(out)


def test_removal_equals_brute_force(spark, odd, odd_rows, empty):
    got = suffix_dedup.remove_repeats(odd)
    assert set(got.columns) >= {"id", "key", "data", "part", "cls"}
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == removed_by_hand([r[:2] for r in odd_rows])
    assert not suffix_dedup.remove_repeats(empty).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300 OR n_chars < 900").select("doc_id", "text")
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs.repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == removed_by_hand([tuple(r) for r in docs.collect()])


# 6 ------------------------------------------------------------------------------------------------------------------
def components_by_hand(rows, similarity=80):
    sets = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][0], rows[b][0]
        both = len(sets[a] & sets[b])
        if x is not None and y is not None and sets[a] and sets[b] and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(x), top(y)))
            up[y] = x
    return Counter((d, len(sets[k]), None if d is None else top(d)) for k, (d, _) in enumerate(rows))


def near_copies(n=60, size=90, edits=5):
    """Families of near copies around the threshold, and texts that share a passage."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [f"u{rng.randrange(5000)}" for _ in range(size // 3)] + base[: size // 2 + rng.randrange(20)]
        for _ in range(rng.randrange(0, edits)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
        rows.append((k, " ".join(words[: rng.choice([size, size, 10, 3])])))
    return rows


@pytest.mark.parametrize("limits", [{}, {"block": 3, "many": 2}])
def test_join_equals_brute_force(spark, limits):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(df, **limits).collect()) == components_by_hand(rows)


def test_a_document_quoted_by_many_keeps_its_own_links(spark):
    """Six shorter texts that quote A sign more often with it than B does, whose likeness to A is exactly 0.8."""
    rng = random.Random(5)
    word = lambda: f"q{rng.randrange(10**7)}"
    rows = []
    for family in range(60):
        a = [word() for _ in range(64)]
        b = [*a, *(word() for _ in range(15))]
        quotes = [[word() for _ in range(20)] + a[s : s + 14] for s in range(0, 60, 10)]
        rows += [(8 * family + k, " ".join(t)) for k, t in enumerate((a, b, *quotes))]
    got = {r["id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k - k % 8 if k % 8 < 2 else k for k in range(8 * 60)}


def test_join_of_odd_tables(odd, odd_rows, empty):
    got = jaccard_join.jaccard_components(odd).collect()
    want = components_by_hand([r[:2] for r in odd_rows])
    # Rows that repeat an id with other texts share its component.
    assert Counter(tuple(r) for r in got) == want
    assert not jaccard_join.jaccard_components(empty).collect()


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for size in (4, 5, 9, 20, 49, 60, 110, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
            b = np.unique(np.r_[a[: max(1, int(len(a) * 0.9))], rng.integers(0, 1 << 62, max(0, size // 10), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            h, offsets = np.r_[a, b], np.r_[0, len(a), len(a) + len(b)]
            sig, owner = jaccard_join.signatures(h, offsets, 80)
            assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
            n, sketch = np.diff(offsets), jaccard_join.sketches(h, offsets, 80)
            order = np.argsort(n, kind="stable")
            near = jaccard_join.by_sketch(n[order], [sketch[k] for k in order], 80)
            assert near(0, np.array([1])).all() and near(1, np.array([0])).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), run_dir(spark, "t")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


# 4 ------------------------------------------------------------------------------------------------------------------
def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(itertools.chain.from_iterable(runs))


PAGES = [(3, "http://b.example.com/x?y=1", "<p>é"), (1, "https://a.example.com:8080/", "<p>é"), (2, None, None), (7, "http://a.example.com/", ""), (5, "not a url]:x", "z" * 300_000), (9, "http://a.example.com/", "z" * 300_000), (None, "http://a.example.com/", "<p>é"), (1, "https://a.example.com:8080/", "<p>é")]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 200_000)
    pages = spark.createDataFrame([(*p, "other", 1) for p in PAGES], "page_id long, url string, html string, file string, offset int").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect())
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = min(j for j, _, x in PAGES if j is not None and (x or "").encode() == raw)
        again = i is not None and i != first
        want[i, len(raw), warc.digest(raw), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    at = run_dir(spark, "t")
    found = sorted(warc.capture_histories(warc.write_archives(pages, at), at).collect(), key=lambda r: r["history_no"])
    order, last = [(r["url_key"], r["capture_ts"]) for r in found], {}
    assert [r["history_no"] for r in found] == list(range(len(found)))
    for key, ts, before in ((r["url_key"], r["capture_ts"], r["previous_ts"]) for r in found):
        assert before == last.get(key)
        last[key] = ts
    assert order == sorted(order) and len(order) == len(PAGES) and warc.url_key(PAGES[0][1]) == "com,example,b)/x?y=1"
    assert warc.archive(pages, min_bytes=10).where("record_type = 'revisit'").count() == 1
    assert not warc.archive(pages.limit(0)).collect()


# 8 ------------------------------------------------------------------------------------------------------------------
def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    tokens = {r["doc_id"]: [*WORD.findall(r["text"].encode().translate(LOWER)), b"\n"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    rows = pitman_yor.scored(docs).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        own = tokens[r["id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_follow_from_the_seats(spark):
    """Scores against the formulas on all seats, in plain Python; probabilities over all words and one unknown sum to one."""
    docs = pitman_yor.prepared(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120"))
    model = pitman_yor.train(docs.select("text", "learn"), run_dir(spark, "t"), 3)
    batches = model.seats.union(model.replies).toArrow().to_batches()
    customers, samples = {}, [({}, Counter(), {}) for _ in model.samples]
    for _, d in pitman_yor.settled(batches, len(model.samples)):
        pairs = list(zip(d.context[d.owner].tolist(), d.word[d.at].tolist()))
        customers |= dict(zip(pairs, d.customers.tolist()))
        for (tables, _, own, seats), (t, totals, root) in zip(d.samples, samples):
            t |= dict(zip(pairs, tables.tolist()))
            root |= dict(zip(d.word.tolist(), zip(own.tolist(), seats.tolist())))
            for (u, _), x in zip(pairs, tables.tolist()):
                totals[u] += x
    c_u = Counter()
    for (u, _), c in customers.items():
        c_u[u] += c
    for s, (t, t_u, root) in zip(model.samples, samples):
        own = Counter()
        for (u, w), x in t.items():
            own[w] += x
            assert (x > 0) == (customers[u, w] > 0) and x <= customers[u, w]
        assert all(root[w][0] == x for w, x in own.items()) and s.root_customers == sum(own.values())
        assert s.root_tables == sum(x for _, x in root.values()) and s.n_words == sum(x > 0 for x in own.values())

    def p(u, w):
        out = 0.0
        for s, (t, t_u, root) in zip(model.samples, samples):
            c, r = root.get(w, (0, 0))
            below = 5.0 + s.root_customers
            parent = (c - s.root_discount * r) / below + (5.0 + s.root_discount * s.root_tables) / below / (s.n_words + 1)
            out += (customers.get((u, w), 0) - s.discount * t.get((u, w), 0) + (5.0 + s.discount * t_u[u]) * parent) / (5.0 + c_u[u])
        return out / len(model.samples)

    known = [w for w, (c, _) in samples[0][2].items() if c]
    for u in [int(pitman_yor.END), *[u for u, _ in c_u.most_common(3)], 12345]:
        assert sum(p(u, w) for w in known) + p(u, 54321) == pytest.approx(1, abs=1e-9)
    got = {r["id"]: r["score"] for r in pitman_yor.answers(docs, model).collect()}
    for r in docs.collect():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        words, at, _ = pitman_yor.tokens(raw, np.array([0, len(raw)]))
        own = words[at].tolist()
        assert got[r["id"]] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip([int(pitman_yor.END), *own], own)), rel=1e-9)
    assert len(got) == docs.count()


def test_scores_do_not_depend_on_passes(spark):
    """Documents scored in several passes, equal rows and null ids among them; what was sent to the root is gone by then."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    docs, at = pitman_yor.prepared(docs), run_dir(spark, "t")
    model = pitman_yor.train(docs.select("text", "learn"), at, 3)
    last = f"{at.removeprefix('file://')}/seats-{pitman_yor.SWEEPS}"
    assert f"kind={pitman_yor.SEATS}" in os.listdir(last) and f"kind={pitman_yor.TO_ROOT}" not in os.listdir(last)
    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    one, four = (sorted(([r[c] for c in names] for r in pitman_yor.answers(docs, model, n).collect()), key=str) for n in (1, 4))
    assert len(one) == len(four) == docs.count()
    for a, b in zip(one, four):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_scores_do_not_depend_on_how_contexts_are_dealt(spark, monkeypatch):
    """With every context hot, or none, counts are the same and held-out scores alike."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    out = []
    for share in (1, 1 << 20):
        monkeypatch.setattr(pitman_yor, "hot_share", lambda n_parts, share=share: share)
        out.append({r["id"]: r for r in pitman_yor.scored(docs).collect()})
    a, b = out
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (b[i]["n_tokens"], b[i]["n_known"], b[i]["train_tokens"])
        assert r["base_score"] == pytest.approx(b[i]["base_score"], rel=1e-9) and r["score"] == pytest.approx(b[i]["score"], rel=0.05)


def test_words_of_any_length_and_at_texts_edges():
    """Splitting and hashing against plain Python: words up to, at and beyond eight and 64 bytes, texts that end in a word."""
    rng = np.random.default_rng(5)
    texts = [b"", b"Ab", b"aB c", b"", b" x\x0b", b"\x08\x0e[@`{ \xc3\x89 \xc3\xa9\x00", b"q" * 5000 + b"R", b"q" * 5000 + b"r" + b" Q" * 3, b""]
    texts += [bytes(rng.choice(np.frombuffer(b"aAb", np.uint8), n)) for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 71, 72, 73, 200) for _ in range(4)]
    texts += [b" ".join(bytes(rng.choice(np.frombuffer(b"aZ\xff", np.uint8), n)) for n in rng.integers(1, 90, 50)) + b"\n" * k for k in range(6)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    known, at, doc = pitman_yor.tokens(raw, offsets)
    want = [(d, w) for d, t in enumerate(texts) for w in [*WORD.findall(t.translate(LOWER)), b"\n"]]
    assert doc.tolist() == [d for d, _ in want] and (known[1:] > known[:-1]).all()
    code = {w: k for k, (_, w) in zip(at.tolist(), want)}
    assert at.tolist() == [code[w] for _, w in want] and len(set(code.values())) == len(code) == len(known) and known[code[b"\n"]] == pitman_yor.END
    assert pitman_yor.tokens(raw[:0], np.zeros(3, np.int64))[1].tolist() == [0, 0]


def test_no_frequent_word_is_missed(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "hot_share", lambda n_parts: 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200").select("text").repartition(5)
    hot, n = pitman_yor.hot_words(docs, 3)
    raw = "\n".join(r["text"] for r in docs.collect()).encode()
    known, at, _ = pitman_yor.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    count = np.bincount(at)
    count[known == pitman_yor.END] = docs.count()
    often = known[count >= count.sum() / 300]
    assert n == count.sum() and 5 < len(often) and hot.holds(often).all() and len(hot.cells) <= 300 and hot.holds(known).sum() < len(often) + 20


def test_counting_takes_no_more_than_its_numbers_do():
    """CPU time against a part of the same work: words were split byte by byte, and numbers packed one byte at a time."""

    def took(run):
        out = []
        for _ in range(5):
            start = time.process_time()
            run()
            out.append(time.process_time() - start)
        return min(out)

    rng = np.random.default_rng(6)
    raw = rng.choice(np.frombuffer(b"abcde \n", np.uint8), 1 << 21)
    offsets = np.arange(0, len(raw) + 1, 1 << 12)
    assert took(lambda: pitman_yor.tokens(raw, offsets)) < took(lambda: jaccard_join.words(raw, offsets))
    x = rng.integers(0, 1 << 60, 1 << 19).astype(np.uint64)
    blob = packing.pack(x)
    assert took(lambda: packing.pack(x)) < 5 * took(lambda: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T))
    assert (packing.unpack(blob, np.uint64)[0] == x).all()
    planes = b"".join(x.view(np.uint8)[k::8].tobytes() for k in range(8))
    assert packing.pack(planes) == blob and packing.unpack(packing.pack(x[:0], b"ab"), np.uint64, bytes)[1] == b"ab"


def test_texts_split_in_blocks(monkeypatch):
    """Blocks end between texts: the same words and counts whatever their size, with long, empty and no texts."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(np.frombuffer(b"abC \n", np.uint8), n)) for n in (0, 5, 700, 63, 64, 65, 0, 0, 1, 128, 0)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    word, count = pitman_yor.split(raw, offsets)
    assert count.tolist() == [len(WORD.findall(t)) for t in texts] and len(word) == count.sum()
    monkeypatch.setattr(pitman_yor, "BLOCK", 64)
    again = pitman_yor.split(raw, offsets)
    assert all((x == y).all() for x, y in zip((word, count), again)) and not len([*pitman_yor.split(raw[:0], np.zeros(1, np.int64))][0])


def test_sweeps_hold_only_pairs_that_can_change(spark):
    """Pairs with one customer are left out of sweeps, but for their sums, and put back with one table."""
    docs = pitman_yor.prepared(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120"))
    model = pitman_yor.train(docs.select("text", "learn"), run_dir(spark, "t"), 3)
    read = lambda kinds: dict(pitman_yor.settled(model.seats.where(F.col("kind").isin(*kinds)).union(model.replies).toArrow().to_batches(), len(model.samples)))
    live, every = read([pitman_yor.SEATS]), read([pitman_yor.SEATS, pitman_yor.PAIRS])
    assert sum(len(d.at) for d in live.values()) < sum(len(d.at) for d in every.values()) / 2
    for part, d in live.items():
        whole = every[part]
        k = np.flatnonzero(whole.customers > 1)
        assert (d.customers > 1).all() and (d.customers == whole.customers[k]).all() and (d.at == whole.at[k]).all() and (d.owner == whole.owner[k]).all()
        for s, t in zip(d.samples, whole.samples):
            assert (s[0] == t[0][k]).all() and (np.delete(t[0], k) == np.delete(whole.customers, k)).all()
            assert (d.by_word(s[0]) + d.lone[0] == whole.by_word(t[0])).all() and (d.by_context(s[0]) + d.lone[1] == whole.by_context(t[0])).all()


def test_numbers_are_packed_narrow():
    x = [np.array([], np.int64), np.array([255, 0]), np.array([256]), np.array([1 << 16]), np.array([1 << 32]), np.array([7], np.uint64), np.array([0.5])]
    got = pitman_yor.unpack_narrow(pitman_yor.pack_narrow(*x))
    assert [g.dtype.itemsize for g in got] == [1, 1, 2, 4, 8, 8, 8] and all((g == y).all() and len(g) == len(y) for g, y in zip(got, x))


def test_search_for_the_descent_ends(monkeypatch):
    """Steps that ended on a bound were thrown back to the middle, and took thirty steps more to return."""
    calls, real = [], np.expm1
    t = np.arange(20.0, 300.0)
    monkeypatch.setattr(seating.np, "expm1", lambda x: calls.append(1) or real(x))
    v = seating.descent(np.full(len(t), 312.0), t, 0.8625690138051494)
    x, f = -real(v), -real(0.8625690138051494 * v)
    assert len(calls) < 30 and x * 0.8625690138051494 * np.exp((0.8625690138051494 - 1) * v) / f == pytest.approx(312 / t, rel=1e-8)


def test_dishes_beyond_the_largest_numbers():
    """Weights of up to 10 ** 9 a table for 256 tables leave the range of numbers; so do those that vanish."""
    table, n = seating.log_stirling(seating.EXACT, 0.6), 2000
    for others, p in ((10**9, 0.999), (10**4, 1e-12), (10**6, 1e-4)):
        law = exact_law(256, others, p, 5.0, 0.6)
        mean = sum(t * x for t, x in enumerate(law, 1))
        got = seating.drawn(np.full(n, 256), np.full(n, others), np.full(n, p), 5.0, 0.6, np.random.default_rng(4), table)
        assert got.mean() == pytest.approx(mean, rel=0.02)


def log_stirling(c, d):
    """log S_d(c, t) for t = 1 to c, by their recursion in plain numbers."""

    def plus(x, y):
        top = max(x, y)
        return top + math.log1p(math.exp(min(x, y) - top)) if min(x, y) > -math.inf else top

    row = [0.0]
    for n in range(1, c):
        row = [plus(row[t - 1] + math.log(n - d * t) if t <= n else -math.inf, row[t - 2] if t > 1 else -math.inf) for t in range(1, n + 2)]
    return row


def exact_law(c, others, p, s, d):
    log = 0.0
    w = []
    for t, x in enumerate(log_stirling(c, d), 1):
        log += math.log((s + d * (others + t - 1)) * p)
        w.append(x + log)
    top = max(w)
    w = [math.exp(x - top) for x in w]
    return [x / sum(w) for x in w]


def test_stirling_numbers_count_seatings():
    """Sums over all seatings of six customers of the tables' weights."""

    def seatings(n):
        if not n:
            yield []
            return
        for rest in seatings(n - 1):
            yield [*rest, 1]
            for k in range(len(rest)):
                yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]

    for d in (0.3, 0.8):
        want = Counter()
        for tables in seatings(6):
            want[len(tables)] += math.prod(math.prod(k - d for k in range(1, n)) for n in tables)
        assert np.exp(log_stirling(6, d)) == pytest.approx([want[t] for t in range(1, 7)])
        assert np.exp(seating.log_stirling(6, d)[6, 1:]) == pytest.approx([want[t] for t in range(1, 7)])


@pytest.mark.parametrize(
    "c, p, others, d",
    [
        (10, 0.1, 0, 0.8), (50, 0.3, 0, 0.8), (100, 0.05, 50, 0.8), (50, 0.01, 1000, 0.8), (2, 0.5, 3, 0.5), (256, 0.2, 10, 0.6), (257, 0.2, 10, 0.6), (1000, 0.05, 50, 0.8), (900, 0.3, 0, 0.8), (1000, 0.9, 10_000, 0.8),
        (600, 0.001, 100_000, 0.8), (900, 0.3, 0, 0.3), (900, 0.05, 50, 0.05), (900, 0.9, 1000, 0.05), (900, 0.001, 1000, 0.95), (1000, 1e-6, 10, 0.7),
    ],
)
def test_tables_are_drawn_from_their_law(c, p, others, d):
    law = exact_law(c, others, p, 5.0, d)
    n = 20_000
    got = seating.drawn(np.full(n, c), np.full(n, others), np.full(n, p), 5.0, d, np.random.default_rng(1), seating.log_stirling(seating.EXACT, d))
    mean = sum(t * x for t, x in enumerate(law, 1))
    spread = math.sqrt(sum(t * t * x for t, x in enumerate(law, 1)) - mean**2)
    assert got.mean() == pytest.approx(mean, rel=0.02, abs=4 * spread / math.sqrt(n))
    assert got.std() == pytest.approx(spread, rel=0.06, abs=0.02)
    few = [np.mean(got == t) for t in range(1, 9)]
    assert few == pytest.approx([*law[:8], *[0] * (8 - len(law))], abs=0.015)


def test_largest_dishes():
    """Beyond any recursion: doubling customers of a stable law multiplies what they would sit at alone by 2 ** d."""
    table = seating.log_stirling(seating.EXACT, 0.6)
    mean = [seating.drawn(np.full(400, c), np.full(400, 10**9), np.full(400, 0.999), 5.0, 0.6, np.random.default_rng(c), table).mean() for c in (10**6, 10**7)]
    assert all(m == pytest.approx(c, rel=0.01) for m, c in zip(mean, (10**6, 10**7)))  # with so many others nearly everyone opens a table
    alone = [seating.drawn(np.full(2000, c), np.zeros(2000), np.ones(2000), 5.0, 0.6, np.random.default_rng(c), table).mean() for c in (300, 10**5)]
    expected = [np.exp(math.lgamma(5 + 0.6 + c) - math.lgamma(5 + c) + math.lgamma(5 + 1) - math.lgamma(5 + 0.6)) / 0.6 - 5 / 0.6 for c in (300, 10**5)]
    assert alone == pytest.approx(expected, rel=0.03)


def test_a_sweep_leaves_the_joint_law_of_a_context_as_it_is():
    """Two dishes of one context, enumerated: sweep after sweep their tables follow the law of both together."""
    one = np.array([0, 0])
    dishes = pitman_yor.Dishes(np.array([1, 2], np.uint64), one, np.array([9], np.uint64), np.array([2]), np.array([18]), np.array([0, 1]), np.array([12, 6]), one, [])
    root = np.array([3 * 10**8, 10**8])  # so large that own tables don't matter
    dishes.samples = [[np.array([1, 1]), np.array([2]), root, root // 10]]
    totals = pitman_yor.Totals(18, 2, 0.7, 0.5, 10**9, 10**8)
    p = totals.root(root, root // 10)
    table, rng = seating.log_stirling(seating.EXACT, 0.7), np.random.default_rng(2)
    seen = []
    for _ in range(4000):
        tables = dishes.drawn(totals, table, rng)
        dishes.samples[-1][:2] = [tables, np.array([tables.sum()])]
        seen.append(tables)
    law = np.zeros((13, 7))
    a, b = np.exp(log_stirling(12, 0.7)), np.exp(log_stirling(6, 0.7))
    for i in range(1, 13):
        for j in range(1, 7):
            law[i, j] = a[i - 1] * b[j - 1] * p[0] ** i * p[1] ** j * math.prod(5 + 0.7 * k for k in range(i + j))
    law /= law.sum()
    want = [(law.sum(1) * np.arange(13)).sum(), (law.sum(0) * np.arange(7)).sum()]
    assert np.mean(seen[100:], 0) == pytest.approx(want, rel=0.03)


def test_scores_of_odd_tables(odd, empty):
    rows = pitman_yor.scored(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] <= 0 for r in rows) and {r["n_tokens"] for r in rows if r["id"] in (5, 6)} == {1}
    assert not pitman_yor.scored(empty).collect()
    held = odd.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    assert {r["score"] for r in pitman_yor.scored(held).collect()} <= {0.0}
