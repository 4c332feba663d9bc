"""The highest-scoring documents of each query item by term weights: a join seeded with a threshold for each item.

1. A pass over the texts writes, for each document, how many terms it has and which terms of the items, how often (a
   forward index; other terms only count for the length). Document counts of the terms come from it, and weights from them.
2. A pass over the index finds the kth largest impact (what a term adds to a score) of each term, and its largest; they are
   stored beside the index. No score is below one of its impacts, so k documents reach the largest kth impact among an
   item's terms: its kth score is at least that, the item's threshold.
3. An item's terms are put in the order of their largest impacts. As long as the sum of the first ones is below the
   threshold, a document with no other term can't reach it: those terms are pruned, by their suffix bound, from the search
   for candidates. The documents that have one of the others are its candidates; those whose impacts so far and the bound
   of the pruned terms stay below the threshold go, and what is left is scored exactly, with all terms. A task raises an
   item's threshold to its own kth score as it goes; the best of all tasks are ranked.

A document's terms meet the items' terms inside the task that reads it; only documents that reach a threshold leave it, so
there is no join of postings that a frequent term could blow up. Items are taken in blocks of a bounded number of terms,
read by the driver and sent to the tasks; each block is a pass (more than one from about ten thousand items on).

Weights, document lengths and impacts are those of ``weights``, ``lengths`` and ``impacts``, all but the logarithm in 64-bit
integers; equal scores rank by ascending id.

Defined results: a null text has no terms; a document counts for N if it has a term; rows that repeat an id are documents of
their own, those without an id too, and rank after all others of their score; items that repeat an id are one item with the
terms of all, those without an id are one item; an item without a known term, or an empty table, gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import pieces, run_dir, written

K = 50
#: Distinct (item, term) pairs of a block: some 10 MB with the driver and with each task.
BLOCK = 400_000
TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
INDEX = "id long, n long, ids array<int>, tfs array<int>"
#: Index rows that are searched at a time.
ROWS = 4096
LOWEST = np.iinfo(np.int64).min

# Lower-cases A-Z; every byte that is no digit, letter or part of a character above U+007F becomes a blank.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: the different terms of each item."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(id_col).cast("long").alias("item"), F.explode(F.regexp_extract_all(low, F.lit(TERMS), F.lit(0))).alias("term")).distinct()


def forward_index(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """id, n (terms), and the numbers of known terms with how often they occur; docs has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(known))
        for part in pieces(batches):
            words = [t.encode().translate(_LOWER).split() if t else [] for t in part.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            found = np.fromiter(map(known.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(words)), n)[found >= 0]
            cells, tf = np.unique(doc * size + found[found >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(cells, np.arange(len(words) + 1) * size), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % size, tf))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["id", "n", "ids", "tfs"])

    return docs.mapInArrow(run, INDEX)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))"""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, exact where the product leaves 64 bits."""
    if not total:
        return np.full(len(n), 50, np.int64)
    if len(n) and int(n.max()) * 50 * n_docs < 1 << 63:
        return 50 + n * (50 * n_docs) // total
    return 50 + np.array([int(x) * 50 * n_docs // total for x in n], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the score of a document."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


@dataclass
class Scale:
    """Corpus counts and the terms' weights, by number."""

    n_docs: int
    total: int
    weight: np.ndarray

    def postings(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and impact of all entries of an index batch, in this order."""
        n, ids, tfs = (part.column(part.schema.get_field_index(c)) for c in ("n", "ids", "tfs"))
        row = np.repeat(np.arange(len(n)), ids.value_lengths().to_numpy())
        term, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        return row, term, impacts(self.weight[term], tf, lengths(n.to_numpy(), self.n_docs, self.total)[row])


def _largest(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group."""
    order = np.lexsort((-value, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def term_bounds(index: DataFrame, scale: Scale, k: int = K) -> DataFrame:
    """term, kth (kth largest impact, null with fewer documents) and top (the largest), for terms that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, value, most = np.zeros(0, np.int32), np.zeros(0, np.int64), 1 << 20
        for part in _slices(batches):
            _, t, x = scale.postings(part)
            term, value = np.r_[term, t], np.r_[value, x]
            if len(term) > most:
                best = _largest(term, value, k)
                term, value = term[best], value[best]
                most = max(most, 2 * len(term))
        best = _largest(term, value, k)
        yield pa.RecordBatch.from_arrays([pa.array(term[best], pa.int32()), pa.array(value[best])], ["term", "impact"])

    best = index.mapInArrow(run, "term int, impact long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("rank") <= k)
    return ranked.groupBy("term").agg(F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"), F.max("impact").alias("top"))


@dataclass
class Plan:
    """Items by number: thresholds, bounds of pruned terms, and the items that search by a term or only score with it."""

    ids: list
    least: np.ndarray
    pruned: np.ndarray
    searching: tuple[np.ndarray, np.ndarray]  # offsets by term, items
    scoring: tuple[np.ndarray, np.ndarray]


def plan(pairs: list[tuple], n_terms: int, kth: np.ndarray, top: np.ndarray) -> Plan:
    """pairs: (item, term number). kth and top are 0 for terms without."""
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    place = {i: k for k, i in enumerate(ids)}
    item, term = np.array([place[i] for i, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)
    least = np.zeros(len(ids), np.int64)
    np.maximum.at(least, item, kth[term])
    least = np.maximum(least, 1)  # scores of 0 aren't told
    order = np.lexsort((term, top[term], item))
    item, term = item[order], term[order]
    start = np.searchsorted(item, np.arange(len(ids)))
    upto = np.cumsum(top[term])
    upto -= np.repeat((upto - top[term])[start], np.diff(np.r_[start, len(item)])) if len(item) else 0
    small = upto < least[item]
    pruned = np.zeros(len(ids), np.int64)
    np.maximum.at(pruned, item[small], upto[small])

    def by_term(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, i = term[chosen], item[chosen]
        at = np.argsort(t, kind="stable")
        return np.searchsorted(t[at], np.arange(n_terms + 1)), i[at]

    return Plan(ids, least, pruned, by_term(~small), by_term(small))


def _spread(lists: tuple[np.ndarray, np.ndarray], term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of the given terms: the entry's place and the item, for each item in its term's list."""
    offsets, items = lists
    n = offsets[term + 1] - offsets[term]
    entry = np.repeat(np.arange(len(term)), n)
    return entry, items[np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[term], n)]


def search(index: DataFrame, scale: Scale, items: Plan, k: int = K) -> DataFrame:
    """item (number), id, score: among others, the k best rows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, least = len(items.ids), items.least.copy()
        best, most = [np.zeros(0, np.int64) for _ in range(4)], 1 << 18  # item, score, id, whether there is no id

        def kept() -> list[np.ndarray]:
            item, score, doc, none = best
            order = np.lexsort((doc, none, -score, item))
            g = item[order]
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
            order, rank = order[rank < k], rank[rank < k]
            full = order[rank == k - 1]
            np.maximum.at(least, item[full], score[full])
            return [x[order] for x in best]

        for part in _slices(batches):
            row, term, impact = scale.postings(part)
            entry, item = _spread(items.searching, term)
            cell, back = np.unique(row[entry] * many + item, return_inverse=True)
            score = np.zeros(len(cell), np.int64)
            np.add.at(score, back, impact[entry])
            near = score + items.pruned[cell % many] >= least[cell % many]
            cell, score = cell[near], score[near]
            # What the pruned terms add, for candidates only.
            entry, item = _spread(items.scoring, term)
            other = row[entry] * many + item
            at = np.searchsorted(cell, other)
            hit = (at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == other) if len(cell) else np.zeros(len(other), bool)
            np.add.at(score, at[hit], impact[entry[hit]])
            item = cell % many
            good = score >= least[item]
            ids = part.column(part.schema.get_field_index("id"))
            none, doc = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            at = cell[good] // many
            best = [np.r_[a, b] for a, b in zip(best, (item[good], score[good], doc[at], none[at].astype(np.int64)))]
            if len(best[0]) > most:
                best = kept()
                most = max(most, 2 * len(best[0]))
        item, score, doc, none = kept()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, mask=none.astype(bool)), pa.array(score)], ["item", "id", "score"])

    return index.mapInArrow(run, "item int, id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item with a score above 0."""
    spark = docs.sparkSession
    at = run_dir(spark, "lexical-search")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pairs = written(item_terms(items, item_col, item_text), f"{at}/items")
    blocks = max(1, -(-pairs.count() // block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    found = None
    for b in range(blocks):
        mine = [(r.item, r.term.encode()) for r in pairs.where(F.col("block") == b).select("item", "term").collect()]  # about ``block`` rows
        part = _block(texts, mine, k, f"{at}/{b}")
        found = part if found is None else found.unionByName(part)
    return found


def _block(texts: DataFrame, pairs: list[tuple], k: int, at: str) -> DataFrame:
    spark = texts.sparkSession
    known = {t: n for n, t in enumerate(sorted({t for _, t in pairs}))}
    index = written(forward_index(texts, known), f"{at}/index")
    count = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("total")).first()
    df, kth, top = (np.zeros(len(known), np.int64) for _ in range(3))
    for r in index.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():  # the block's terms
        df[r.term] = r.df
    scale = Scale(count.docs, count.total or 0, weights(df, count.docs))
    for r in written(term_bounds(index, scale, k), f"{at}/bounds").toLocalIterator():
        kth[r.term], top[r.term] = r.kth or 0, r.top
    items = plan([(i, known[t]) for i, t in pairs], len(known), kth, top)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")  # no more than the block has
    best = search(index, scale, items, k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
