"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased, and runs of ASCII characters that are neither letters nor digits become one
blank. Items are cut into overlapping patterns, of 96 bytes every 48 and of 64 bytes every 16 (``CUTS``; shorter items are
one pattern), so any stretch of 79 bytes of an item holds a whole pattern, wherever it starts. A pattern of m
bytes has an edit budget of e = m / 10, less where the bound below would vanish. An occurrence with e edits or fewer
shares at least t = m - q + 1 - q * e of its q-grams with the pattern, on diagonals that lie e apart or less. So

1. each text position whose q-gram (q = 8) is one of the benchmark's gives a hit for each place of it in a pattern; hits
   in stretches too sparse to hold t, or on diagonals of an item where too few lie together, are left out first, which
   loses none;
2. hits are counted per pattern in diagonal bands of BAND + budget, BAND apart, so that bands overlap and one holds all
   diagonals of an occurrence; bands with t hits or more are kept;
3. kept bands are verified by banded alignment: the pattern against any stretch of the text on the band's diagonals.

Items are written to the shared folder in blocks of at most ``BLOCK`` bytes (an item at least); neither the driver nor a
closure holds them. Documents are read once, whatever the benchmark's size: a task goes through all blocks, one in memory at
a time, for each ``WIDE_PIECE`` bytes of its documents. The shared folder is opened through pyarrow there, so it has to be of
a kind that pyarrow knows (local, HDFS, S3, GCS).

Defined results: null or empty texts and items, and items under q bytes, match nothing; repeated rows match alike;
equal items each get their rows; a null id gives rows with a null id, and items without one share theirs; an empty table
on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import estimated_bytes, id_and_text, pieces, run_dir

Q, PATTERN, BAND, RATE = 8, 96, 16, 10
#: Hits are first counted by item in wider bands, each in one of 2 ** CELL_BITS cells.
WIDE, CELL_BITS = 64, 22
#: Patterns' bytes and how far apart they start: long ones for their larger budget, short ones for parts of items.
CUTS = ((PATTERN, 48), (64, 16))
BLOCK = 1 << 20
#: Bytes of text that are searched at a time, and for which a block is made.
PIECE, WIDE_PIECE = 4 << 20, 64 << 20
BITS = 20
#: More bytes than any budget has edits: no match reaches from one text into the next.
APART = b"\xff" * 16

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 32


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, each followed by APART that no pattern has, and where each starts (and the last ends)."""
    raw = [t.lower().encode() for t in texts]
    joined = np.frombuffer(b"".join(r + APART for r in raw), np.uint8)
    plain = _CLASS[joined]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    ends = np.cumsum([len(r) + len(APART) for r in raw], dtype=np.int64)
    return plain[keep], np.r_[0, np.cumsum(keep)[ends - 1]] if len(raw) else np.zeros(1, np.int64)


def grams(raw: np.ndarray) -> np.ndarray:
    """The q-gram from each position as a number, by doubling."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    g, step = raw.astype(np.uint64), 1
    while step < Q:
        g = g[:-step] | g[step:] << np.uint64(8 * step)
        step *= 2
    return g


def slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Patterns:
    """A block of items: their patterns and q-grams. A pattern's item is its index in ``ids``."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        raw, at = normalised([t for _, t in items])
        text, item, size, whole = [], [], [], []
        for k in range(len(items)):
            own = raw[at[k] : at[k + 1] - len(APART)].tobytes().strip()
            whole.append(own if len(own) >= Q else b"")
            lasts = [max(0, len(own) - length) for length, _ in CUTS]
            for s, e in sorted({(s, min(s + length, len(own))) for (length, stride), last in zip(CUTS, lasts) for s in (*range(0, last, stride), last)}):
                piece = own[s:e]
                if len(piece) >= Q:
                    text.append(np.frombuffer(piece.ljust(PATTERN, b"\xfe"), np.uint8))
                    item.append(k)
                    size.append(len(piece))
        self.ids = pa.array([i for i, _ in items], pa.int64())
        self.item, self.size = np.array(item, np.int64), np.array(size, np.int64)
        self.text = np.stack(text) if text else np.zeros((0, PATTERN), np.uint8)
        self.budget = np.minimum(self.size // RATE, (self.size - Q) // Q)
        self.least = self.size - Q + 1 - Q * self.budget
        which = np.repeat(np.arange(len(size)), np.maximum(0, self.size - Q + 1))
        place = np.arange(len(which)) - np.repeat(np.cumsum(self.size - Q + 1) - (self.size - Q + 1), self.size - Q + 1)
        gram = np.concatenate([grams(t[:s]) for t, s in zip(self.text, self.size)]) if len(size) else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.which, self.place = which[order], place[order]
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << BITS, bool)
        self.known[slot(self.gram)] = True
        # The same q-grams by item, with the fewest hits that any pattern of the item needs.
        gram = np.concatenate([np.zeros(0, np.uint64), *(grams(np.frombuffer(w, np.uint8)) for w in whole)])
        owner = np.repeat(np.arange(len(whole)), [max(0, len(w) - Q + 1) for w in whole])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(max(0, len(w) - Q + 1)) for w in whole)])
        order = np.argsort(gram, kind="stable")
        self.in_item, self.item_place = owner[order], place[order]
        self.item_first = np.searchsorted(gram[order], self.gram)
        self.item_times = np.searchsorted(gram[order], self.gram, side="right") - self.item_first
        self.item_least = np.full(len(items), PATTERN)
        np.minimum.at(self.item_least, self.item, self.least)
        self.longest = max(map(len, whole), default=0)

    def hits(self, raw: np.ndarray) -> np.ndarray:
        """Positions with a benchmark q-gram, in stretches that hold enough of them; and which q-gram."""
        gram = grams(raw)
        at = np.flatnonzero(self.known[slot(gram)])
        which = np.searchsorted(self.gram, gram[at])
        which[which == len(self.gram)] = 0
        good = self.gram[which] == gram[at]
        at, which = at[good], which[good]
        # A hit counts only if it is one of ``least`` that lie in some stretch of ``span`` positions.
        at, which = self.dense(at, which)
        return self.gathered(at, which)

    def dense(self, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, span = int(self.least.min()), PATTERN + int(self.budget.max())
        first = np.zeros(len(at) + 1, np.int32)
        full = np.flatnonzero(at[least - 1 :] - at[: max(0, len(at) - least + 1)] < span)
        np.add.at(first, full, 1)
        np.add.at(first, full + least, -1)
        ok = np.cumsum(first[:-1]) > 0
        return at[ok], which[ok]

    def gathered(self, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hits that lie with as many as a pattern needs on an item's diagonals.

        A pattern's band lies within one of the item's bands, WIDE diagonals apart and overlapping by a band's width.
        Cells that several bands share only let more hits pass.
        """
        ok = np.zeros(len(at), bool)
        overlap, n_items = BAND + int(self.budget.max()), len(self.item_least)
        for s in range(0, len(at), 1 << 18):
            # Hits whose bands meet those of this part are counted with it.
            e = min(len(at), s + (1 << 18))
            reach = self.longest + WIDE + overlap
            lo, hi = int(np.searchsorted(at, at[s] - 2 * reach)), int(np.searchsorted(at, at[e - 1] + 2 * reach))
            w = which[lo:hi]
            n = self.item_times[w]
            hit = np.repeat(np.arange(lo, hi), n)
            k = np.repeat(self.item_first[w] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            item = self.in_item[k]
            diagonal = at[hit] - self.item_place[k] + reach
            band = diagonal // WIDE
            also = diagonal % WIDE < overlap
            band, item, hit = np.r_[band, band[also] - 1], np.r_[item, item[also]], np.r_[hit, hit[also]]
            cell = ((band * n_items + item).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            good = np.bincount(cell, minlength=1 << CELL_BITS)[cell] >= self.item_least[item]
            ok[hit[good]] = True
        return at[ok], which[ok]

    def candidates(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, first diagonal) of the bands that hold enough hits."""
        at, which = self.hits(raw)
        none = np.zeros(0, np.int64)
        found_p, found_d = [none], [none]
        for s in range(0, len(at), 100_000):  # hits in order of position, so bands of a text lie together
            e = min(len(at), s + 100_000)
            # Go on to where a band that starts in this part can't reach, and begin as far back.
            lo = np.searchsorted(at, at[s] - 2 * PATTERN)
            hi = np.searchsorted(at, at[e - 1] + 2 * PATTERN)
            p, w = at[lo:hi], which[lo:hi]
            n = self.times[w]
            k = np.repeat(self.first[w] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pattern = self.which[k]
            diagonal = np.repeat(p, n) - self.place[k] + (PATTERN + BAND)
            band = diagonal // BAND
            also = diagonal % BAND < self.budget[pattern]  # the band before reaches here
            key = np.concatenate([band * len(self.item) + pattern, (band[also] - 1) * len(self.item) + pattern[also]])
            key, count = np.unique(key, return_counts=True)
            pattern = key % len(self.item)
            key = key[count >= self.least[pattern]]
            found_p.append(key % len(self.item))
            found_d.append(key // len(self.item) * BAND - (PATTERN + BAND))
        both = np.unique(np.stack([np.concatenate(found_d), np.concatenate(found_p)], 1), axis=0)
        return both[:, 1], both[:, 0]

    def verified(self, raw: np.ndarray, pattern: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each candidate on its band, by banded alignment, and the position after its best end."""
        width = BAND + int(self.budget.max()) + 1
        padded = np.concatenate([np.full(PATTERN + BAND, 255, np.uint8), raw, np.full(2 * PATTERN + width, 255, np.uint8)])
        start = diagonal + PATTERN + BAND
        cols = np.arange(width)
        cost = np.zeros((len(pattern), width), np.int16)
        best = np.zeros_like(cost)
        size = self.size[pattern]
        for i in range(int(size.max(initial=0))):
            step = cost + (padded[(start + i)[:, None] + cols] != self.text[pattern, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = (np.minimum.accumulate(step - cols, 1) + cols).astype(np.int16)
            best[size == i + 1] = cost[size == i + 1]
        return best.min(1, initial=PATTERN), diagonal + size + best.argmin(1) if len(best) else size

    def search(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text's index, item, edits, place after the match in the normalised text) of all verified patterns."""
        raw, at = normalised(texts)
        pattern, diagonal = self.candidates(raw)
        found = [(np.zeros(0, np.int64),) * 4]
        for s in range(0, len(pattern), 4096):
            p = pattern[s : s + 4096]
            edits, end = self.verified(raw, p, diagonal[s : s + 4096])
            ok = edits <= self.budget[p]
            doc = np.searchsorted(at, end[ok] - 1, side="right") - 1
            found.append((doc, self.item[p[ok]], edits[ok].astype(np.int64), end[ok] - at[doc]))
        return tuple(np.concatenate(x) for x in zip(*found))


def written_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> str:
    """The items in blocks of bounded size, a row each, in a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for part in batches:
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if ids and size + len(text) > BLOCK:
                    yield _block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield _block(ids, texts)

    at = run_dir(benchmark.sparkSession, "decontaminate")
    items = id_and_text(benchmark, id_col, text_col)
    few = max(1, -(-4 * estimated_bytes(benchmark) // BLOCK))
    items.coalesce(few).mapInArrow(run, "ids array<long>, texts array<string>").write.parquet(at)
    return at


def _block(ids: list, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], ["ids", "texts"])


class Blocks:
    """The blocks of a folder, read and made into patterns one after another; a single one is kept."""

    def __init__(self, folder: str) -> None:
        self.folder, self.kept = folder, None

    def __iter__(self) -> Iterator[Patterns]:
        if self.kept is not None:
            yield from self.kept
            return
        files, root = pa.fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pa.fs.LocalFileSystem(), self.folder)
        made, last = 0, None
        for info in sorted(files.get_file_info(pa.fs.FileSelector(root)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    for row in pq.ParquetFile(f).iter_batches(1):
                        last = Patterns(list(zip(row.column(0)[0].as_py(), row.column(1)[0].as_py())))
                        made += 1
                        if len(last.item):
                            yield last
        if made < 2:
            self.kept = [last] if last is not None and len(last.item) else []


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item_id, n_patterns (bands verified), min_edits, last_end for each document and item that match."""
    folder = written_blocks(benchmark, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder)
        for wide in pieces(batches, WIDE_PIECE):
            for block in blocks:
                for part in pieces([wide], PIECE):
                    doc, item, edits, end = block.search(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), block.ids.take(pa.array(item)), pa.array(edits), pa.array(end)], ["id", "item_id", "edits", "end"])

    found = id_and_text(documents, id_col, text_col).mapInArrow(run, "id long, item_id long, edits long, end long")
    return found.groupBy("id", "item_id").agg(F.count("*").alias("n_patterns"), F.min("edits").alias("min_edits"), F.max("end").alias("last_end"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text matches no item, with all their columns."""
    at = documents.columns.index(text_col)
    folder = written_blocks(benchmark, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder)
        for wide in pieces(batches, WIDE_PIECE, text_col):
            keep = np.ones(wide.num_rows, bool)
            for block in blocks:
                first = 0
                for part in pieces([wide], PIECE, text_col):
                    keep[first + block.search([t or "" for t in part.column(at).to_pylist()])[0]] = False
                    first += part.num_rows
            yield wide.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)


def op1_qgram_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain, up to a tenth of edits."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
