"""Language-model scores from a hierarchical Pitman-Yor model seated by Gibbs sampling.

Tokens are words (split by ASCII white space, A-Z as a-z) and an end after each text. Below a root restaurant, whose
base is even over the words known and one unknown, lies a restaurant for every word that comes before another (the end
stands before a text's first word). All have the root as parent: a table in a context is a customer of the root. With
customers c, tables t, discount d and strength s,

    p(w | u) = (c_uw - d * t_uw) / (s + c_u) + (s + d * t_u) / (s + c_u) * p(w)

and likewise p(w) over the base. A Gibbs sweep goes through the dishes of every context and draws the number of tables
at which a dish's customers sit from the Chinese restaurant's law, given the other dishes: the dish's own tables are taken
out of its context's and of the root's customers first (``seating.drawn``). A context's dishes are drawn one after
another, of more than ``seating.ROUNDS`` some together; contexts see the root, and the root the contexts, as the last
sweep left them, as is usual when sampling in parallel. Scores average the predictive probabilities of the last ``KEPT``
of ``SWEEPS`` sweeps. Discounts are estimated from the counts of counts.

Pairs of context and word are dealt by context, so a context's totals are at hand where it lies. Each partition sends
the root's partitions, which are dealt by word, its tables summed by word, and gets back each of its words' customers
and tables at the root. Contexts with a share of the tokens that may be too much for one partition (``hot_share``, found
by counts of cells of words' hashes, so that no such word is missed) are dealt by pair, and their totals go the same way
as the root's. Pairs that are only met in texts not learned from are counted with no customers, so every pair asked for
has a place. A pair with one customer has one table for good: sweeps go over the others only, and the list of all pairs
is written once. What scores a pair is worked out once after the last sweep. To score, a slice's tokens go to their
pairs' partitions in packed rows, and documents get sums back; pairs as frequent as hot contexts, of which there are
few, are scored where they are read. Documents are dealt to ``PASSES`` that are scored one after another, so what one
sends is gone from the disks before the next; small inputs need one. What is gathered grows with the corpus: all its
pairs of words.

Defined results: a null or empty text is its end alone; rows with a null id aren't learned from and aren't held out;
repeated rows are counted and scored each; very long texts are read whole; without any training text every token has
probability 1; an empty table gives no rows; other columns are ignored. Words and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seating
from .packing import cut, pack, release, unpack
from .util import buffers, estimated_bytes, lean, partitions, pieces, remove, run_dir, written

SWEEPS, KEPT, STRENGTH, SEED = 3, 2, 5.0, 11
FOLDS = 10
SLICE, ASK = 8 << 20, 4 << 20  # bytes of text whose tokens are counted, and asked for, together
BLOCK = 1 << 17  # bytes of text that are split at a time, so that what is worked out of them stays in the processor's cache
#: Passes over the documents for scoring, each of PASS bytes of input at least.
PASSES, PASS = 4, 32 << 20
END = np.uint64(0xE4D0F7E57A11ED01)
#: Words are hashed by eight bytes at a time, the first AHEAD for all words together.
AHEAD, ODD = 8, np.uint64(0x9E3779B97F4A7C15)
_KEPT_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Cells of hashes are summed in so many ranges.
RANGES = 64


def hot_share(n_parts: int) -> int:
    """Contexts and pairs with one of so many tokens or more are dealt apart; bounds what the driver and all tasks hold."""
    return min(max(20_000, 2 * n_parts), 1 << 20)


def mix(h: np.ndarray) -> np.ndarray:
    """A hash of numbers, worked out in two arrays."""
    x = h >> np.uint64(30)
    x ^= h
    x *= np.uint64(0xBF58476D1CE4E5B9)
    y = x >> np.uint64(27)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    return x


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z as a-z), and how many words each text has."""
    edges = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(BLOCK, len(raw), BLOCK)), len(offsets) - 1])
    parts = [_split(raw[offsets[i] : offsets[k]], offsets[i : k + 1] - offsets[i]) for i, k in zip(edges[:-1], edges[1:])]
    return (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    lower = np.zeros(len(raw) + 8, np.uint8)
    np.add(raw, (raw - np.uint8(65) < 26).view(np.uint8) << 5, out=lower[: len(raw)])
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(raw))]
    first[bounds], last[bounds - 1] = inside[bounds], inside[bounds - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    del inside, first, last
    eight = np.ndarray((len(raw) + 1,), "<u8", lower, strides=(1,))  # from each place on
    odd = ODD * np.arange(AHEAD, dtype=np.uint64)
    h, live = mix(eight[start] & _KEPT_BYTES[np.minimum(size, 8)]), np.flatnonzero(size > 8)
    for k in range(1, AHEAD):
        h[live] += mix((eight[start[live] + 8 * k] & _KEPT_BYTES[np.minimum(size[live] - 8 * k, 8)]) + odd[k])
        live = live[size[live] > 8 * (k + 1)]
    if len(live):  # few, of any length
        n = (size[live] - 1) // 8 + 1 - AHEAD
        edge = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(edge, n) + AHEAD
        left = np.repeat(size[live], n) - 8 * k
        h[live] += np.add.reduceat(mix((eight[np.repeat(start[live], n) + 8 * k] & _KEPT_BYTES[np.minimum(left, 8)]) + ODD * k.astype(np.uint64)), edge)
    return mix(h ^ size.astype(np.uint64)), np.diff(np.searchsorted(start, offsets))


def order_of(x: np.ndarray) -> np.ndarray:
    """What sorts numbers from 0 on, equal ones by place: places are put below the numbers, which sort faster by themselves."""
    bits = len(x).bit_length()
    if len(x) and int(x.max()).bit_length() + bits < 64:
        return np.sort(x << bits | np.arange(len(x))) & ((1 << bits) - 1)
    return np.argsort(x, kind="stable")


def starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values in sorted numbers start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[starts(x)]


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of numbers from 0 on, in order, and the index of each among them."""
    order, at = order_of(x), np.empty(len(x), np.int64)
    edge = starts(x[order])
    at[order] = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(x)]))
    return x[order[edge]], at


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens in order, the index among them of each token, the index of its text."""
    word, count = split(raw, offsets)
    coded = pa.array(word).dictionary_encode()
    known = np.append(coded.dictionary.to_numpy(), END)
    order, place = np.argsort(known), np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    at = np.insert(coded.indices.to_numpy(), np.cumsum(count), len(known) - 1)
    return known[order], place[at], np.repeat(np.arange(len(count)), count + 1)


def pair_keys(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each token: context and word as one number, the word in its lowest bits."""
    out = np.empty_like(at)
    out[:1], out[1:] = np.searchsorted(known, END), at[:-1]
    out <<= len(known).bit_length()
    out |= at
    return out


def parted(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of pair_keys."""
    bits = len(known).bit_length()
    return keys >> bits, keys & ((1 << bits) - 1)


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64, np.float64)


def pack_narrow(*arrays: np.ndarray) -> bytes:
    """pack(), with numbers from 0 on in as few bytes as they take; hashes (uint64) and floats as they are."""
    bits = lambda a: int(a.max(initial=0)).bit_length()
    kinds = [_WIDTHS.index(a.dtype.type) if a.dtype in (np.uint64, np.float64) else sum(bits(a) > n for n in (8, 16, 32)) for a in arrays]
    return bytes([len(kinds), *kinds]) + pack(*(a.astype(_WIDTHS[k], copy=False) for a, k in zip(arrays, kinds)))


def unpack_narrow(blob: bytes) -> list[np.ndarray]:
    n = blob[0]
    return unpack(memoryview(blob)[n + 1 :], *(_WIDTHS[k] for k in blob[1 : n + 1]))


def pair_hash(context: np.ndarray, mixed_word: np.ndarray) -> np.ndarray:
    """Of a pair; the word is given as mix(word)."""
    return mix(context ^ mixed_word)


@dataclass
class Hot:
    """Sorted cells of hashes, a hash's first bits, that hold a word of one of hot_share tokens, or words as frequent together."""

    shift: int
    cells: np.ndarray

    def holds(self, word: np.ndarray) -> np.ndarray:
        return isin_sorted(word >> np.uint64(self.shift), self.cells)


def isin_sorted(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


@dataclass
class Totals:
    """What all partitions know of a sample."""

    n_tokens: int
    n_words: int
    discount: float
    root_discount: float
    root_customers: int
    root_tables: int

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """p(w) of words with so many customers and tables at the root."""
        below = STRENGTH + self.root_customers
        return (customers - self.root_discount * tables) / below + (STRENGTH + self.root_discount * self.root_tables) / below / (self.n_words + 1)

    def root_without(self, customers: np.ndarray, tables: np.ndarray, own: np.ndarray) -> np.ndarray:
        """p(w) once a dish has taken its own tables, customers of the root, out of it."""
        left = customers - own
        seats = np.minimum(tables, left)
        below = STRENGTH + self.root_customers - own
        return (left - self.root_discount * seats) / below + (STRENGTH + self.root_discount * (self.root_tables - tables + seats)) / below / (self.n_words + 1)

    def context(self, customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """p(w | u)."""
        return (customers - self.discount * tables + (STRENGTH + self.discount * all_tables) * parent) / (STRENGTH + all_customers)


class Dishes:
    """A partition's contexts and words, sorted, and their pairs' customers; of each sample the tables and totals.

    A sample is [tables of pairs, tables of contexts, customers and tables of words at the root]; but for the pairs' tables
    the last sample's are known only with the root's replies. Tables of pairs with one customer don't change, so sweeps are
    over pairs with more (``live``) and hold the ``lone`` tables of words and contexts; the other pairs lie apart and are put
    back to score.
    """

    def __init__(self, word, count, context, each, total, at, customers, others, samples, lone=None) -> None:
        self.word, self.context, self.others = word, context, others
        self.each, self.at, self.customers = (x.astype(np.int64) for x in (each, at, customers))
        self.here, self.count, self.total = (count, total), count.copy(), total.copy()
        self.samples, self.lone = samples, lone
        self.owner = np.repeat(np.arange(len(context)), self.each)

    @classmethod
    def unpacked(cls, blob: bytes, samples: int, pairs: bytes | None = None) -> Dishes:
        word, count, context, each, total, at, customers, *rest = unpack_narrow(blob)
        count, total, *rest = (x.astype(np.int64) for x in (count, total, *rest))
        lone, samples = rest[:2], [rest[k : k + 4] for k in range(2, 2 + 4 * samples, 4)]
        if pairs is None:
            return cls(word, count, context, each, total, at, customers, None, samples, lone)
        each, at, customers, others = unpack_narrow(pairs)
        live = np.flatnonzero(customers > 1)
        for s in samples:
            tables = np.minimum(customers, 1).astype(np.int64)
            tables[live] = s[0]
            s[0] = tables
        return cls(word, count, context, each, total, at, customers, others.astype(np.int64), samples)

    def live(self) -> Dishes:
        k, one = np.flatnonzero(self.customers > 1), self.customers == 1
        each = np.bincount(self.owner[k], minlength=len(self.context))
        samples = [[tables[k], *rest] for tables, *rest in self.samples]
        return Dishes(self.word, self.here[0], self.context, each, self.here[1], self.at[k], self.customers[k], None, samples, [self.by_word(one), self.by_context(one)])

    def packed(self) -> bytes:
        return pack_narrow(self.word, self.here[0], self.context, self.each, self.here[1], self.at, self.customers, *self.lone, *(x for s in self.samples for x in s))

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, x, minlength=len(self.word)).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, x, minlength=len(self.context)).astype(np.int64)

    def fresh(self, tables: np.ndarray) -> list:
        """A sample as far as it is known here."""
        none = np.zeros(len(self.word), np.int64)
        return [tables, self.by_context(tables) + (self.lone[1] if self.lone else 0), none, none]

    def told(self, replies: list[bytes]) -> None:
        """Take the root's replies into the last sample; each is in the order of the words that went to its sender."""
        _, of_contexts, customers, tables = self.samples[-1]
        order = runs = None
        for blob in replies:
            (sender, n_parts), count, own, seats, context, total, theirs = unpack_narrow(blob)
            if order is None:
                order, runs = self.by_root(int(n_parts))
            i, k = order[slice(*runs.get(int(sender), (0, 0)))], np.searchsorted(self.context, context)
            self.count[i], customers[i], tables[i] = count, own, seats
            self.total[k], of_contexts[k] = total, theirs
        self.samples[-1] = [self.samples[-1][0], of_contexts, customers, tables]

    def by_root(self, n_parts: int) -> tuple[np.ndarray, dict]:
        """The words' places, ordered by the root's partitions, and where each partition's run starts and ends."""
        to = (self.word % np.uint64(n_parts)).astype(np.int64)
        order = order_of(to)
        return order, {p: (s, e) for p, s, e in cut(len(to), to[order])}

    def drawn(self, totals: Totals, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of all pairs, each drawn given the others; table: seating.log_stirling."""
        tables, of_contexts, customers, root_tables = self.samples[-1]
        tables, of_contexts = tables.copy(), of_contexts.copy()
        for k in seating.rounds(self.owner, self.customers):
            own, u, w = tables[k], self.owner[k], self.at[k]
            parent = totals.root_without(customers[w], root_tables[w], own)
            tables[k] = seating.drawn(self.customers[k], of_contexts[u] - own, parent, STRENGTH, totals.discount, rng, table)
            np.add.at(of_contexts, u, tables[k] - own)
        return tables

    def row(self, part: int, n_parts: int, hot: Hot, seen: np.ndarray, sums: tuple = (), pairs: tuple = ()) -> Iterator[pa.RecordBatch]:
        """Of live dishes the state's row, that of all pairs if given, and the rows for the root's partitions: words with tables,
        counts and the root's tables as seen here, hot contexts likewise."""
        tables, of_contexts = self.samples[-1][:2]
        by_word, (count, total) = self.by_word(tables) + self.lone[0], self.here
        own = np.flatnonzero(hot.holds(self.context))
        wo, runs_w = self.by_root(n_parts)
        to_c = (self.context[own] % np.uint64(n_parts)).astype(np.int64)
        co = order_of(to_c)
        runs_c = {p: (s, e) for p, s, e in cut(len(to_c), to_c[co])}
        parts, kinds, data = [part], [SEATS], [self.packed()]
        if pairs:
            parts, kinds, data = [part, part], [SEATS, PAIRS], [*data, pack_narrow(*pairs)]
        for p in sorted(runs_w.keys() | runs_c.keys()):
            i = wo[slice(*runs_w.get(p, (0, 0)))]
            k = own[co[slice(*runs_c.get(p, (0, 0)))]]
            parts.append(p)
            kinds.append(TO_ROOT)
            data.append(pack_narrow(np.array([part]), self.word[i], count[i], by_word[i], self.context[k], total[k], of_contexts[k], seen[i]))
        yield batch_of(parts, kinds, data, [list(sums)] + [[]] * (len(parts) - 1))


STATE = "part int, kind int, data binary, sums array<long>"
SEATS, PAIRS, REPLY, PLACED, ASKED, ROSTER, PARTIAL, TO_ROOT, OFTEN = range(9)
# Sent to the root (TO_ROOT): sender, words, their counts and tables, hot contexts, their customers and tables, the root's
# tables as seen by the sender. Replied: sender and number of partitions; of the words as they were sent count, customers,
# tables; hot contexts, customers, tables.


def batch_of(parts: list, kinds: list, data: list, sums: list | None = None) -> pa.RecordBatch:
    columns = [pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())]
    names = ["part", "kind", "data"]
    if sums is not None:
        columns, names = [*columns, pa.array(sums, pa.list_(pa.int64()))], [*names, "sums"]
    return pa.RecordBatch.from_arrays(columns, names)


# -- frequent words ---------------------------------------------------------------------------------------------------


def cells_of(shift: int):
    """How many of a task's tokens fall in each cell of hashes, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << 64 - shift, np.int64)
        for piece in pieces(batches, SLICE):
            word, count = split(*buffers(piece.column(0)))
            cells += np.bincount((word >> np.uint64(shift)).view(np.int64), minlength=len(cells))
            cells[int(END) >> shift] += len(count)
        data = [(k, pack(x)) for k, x in enumerate(cells.reshape(RANGES, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in data], pa.int32()), pa.array([x for _, x in data], pa.binary())], ["part", "data"])

    return lean(run)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each range."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[part] = held.get(part, 0) + unpack(blob, np.int64)[0]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(x) for x in held.values()], pa.binary())], ["part", "data"])


def most(share: int, shift: int):
    """Cells with one of share tokens or more, and the number of tokens, from the sums of all ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((RANGES, (1 << 64 - shift) // RANGES), np.int64)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells[part] = unpack(blob, np.int64)[0]
        cells, n = cells.ravel(), int(cells.sum())
        found = np.flatnonzero((cells > 0) & (cells >= n / share)).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([pack(found)], pa.binary()), pa.array([n], pa.int64())], ["data", "n"])

    return run


def hot_words(texts: DataFrame, n_parts: int) -> tuple[Hot, int]:
    """All words with one of hot_share tokens or more, and few others; the number of tokens.

    There are 16 cells at least for each that can be hot, so hot cells are a sixteenth of all at most.
    """
    share, schema = hot_share(n_parts), "part int, data binary"
    shift = 64 - max(20, (16 * share - 1).bit_length())
    found = texts.mapInArrow(cells_of(shift), schema).repartition(min(n_parts, RANGES), "part").mapInArrow(added, schema)
    rows = found.coalesce(1).mapInArrow(most(share, shift), "data binary, n long").collect()
    if not rows:
        return Hot(shift, np.zeros(0, np.uint64)), 0
    return Hot(shift, unpack(bytes(rows[0]["data"]), np.uint64)[0]), rows[0]["n"]


# -- counting and seating -----------------------------------------------------------------------------------------------


def dealt(known: np.ndarray, keys: np.ndarray, hot: Hot, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The partitions of pairs; the places of those with a hot context, and their hashes."""
    (context, word), n = parted(known, keys), np.uint64(n_parts)
    out = (known % n).astype(np.int64)[context]
    apart = np.flatnonzero(hot.holds(known)[context])
    hashes = pair_hash(known[context[apart]], mix(known)[word[apart]])
    out[apart] = hashes % n
    return out, apart, hashes


def named(known: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """Sorted pairs as words, contexts, the number of each context's pairs, and their words' indices."""
    context, word = parted(known, keys)
    new = starts(context)
    used, at = ranked(word)
    return [known[used], known[context[new]], np.diff(np.r_[new, len(keys)]), at]


def counted(n_parts: int, hot: Hot):
    """Texts, and whether they are learned from, to packed rows of pairs with counts, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, SLICE):
            known, at, doc = tokens(*buffers(piece.column(0)))
            learn = piece.column(1).to_numpy(zero_copy_only=False)[doc]
            each = np.sort(pair_keys(known, at) << 1 | learn)
            del at, doc, learn
            edge = starts(each >> 1)
            keys, own = each[edge] >> 1, np.add.reduceat(each & 1, edge)
            others = np.diff(np.r_[edge, len(each)]) - own
            to, *_ = dealt(known, keys, hot, n_parts)
            order = order_of(to)
            runs = cut(len(keys), to[order])
            keys, own, others = keys[order], own[order], others[order]
            data = [pack_narrow(*named(known, keys[s:e]), own[s:e], others[s:e]) for _, s, e in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    return lean(run)


def combined(n_parts: int, hot: Hot):
    """A partition's counts to its dishes, each with one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(blob)
        for part, blobs in held.items():
            got = [unpack_narrow(b) for b in blobs]
            blobs.clear()
            word, context = (different(np.concatenate([g[k] for g in got])) for k in (0, 1))
            key = np.concatenate([np.repeat(np.searchsorted(context, g[1]), g[2]) * len(word) + np.searchsorted(word, g[0])[g[3]] for g in got])
            customers, others = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (4, 5))
            del got
            order = order_of(key)
            key = key[order]
            edge = starts(key)
            customers, others, key = np.add.reduceat(customers[order], edge), np.add.reduceat(others[order], edge), key[edge]
            owner = key // len(word)
            each, at, none = np.bincount(owner, minlength=len(context)), key - owner * len(word), np.zeros(len(word), np.int64)
            count, total = (np.bincount(x, customers, minlength=len(y)).astype(np.int64) for x, y in ((at, word), (owner, context)))
            dishes = Dishes(word, count, context, each, total, at, customers, others, [])
            dishes.samples = [dishes.fresh(np.minimum(customers, 1))]
            yield from dishes.live().row(part, n_parts, hot, none, (int((customers == 1).sum()), int((customers == 2).sum())), (each, at, customers, others))

    return lean(run)


def rooted(sweep: int, before: Totals | None, n_parts: int):
    """The root: customers from all partitions, tables seated anew; what each partition has to know of it.

    Sums: tokens, words, words with one and two customers, customers, tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        table = seating.log_stirling(seating.EXACT, before.root_discount) if before is not None else None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(unpack_narrow(blob))
        for part, got in held.items():
            got.sort(key=lambda g: g[0][0])
            word, at = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
            count, customers = (np.bincount(at, np.concatenate([g[k] for g in got]), minlength=len(word)).astype(np.int64) for k in (2, 3))
            tables = np.minimum(customers, 1)
            if before is not None:
                seen = np.zeros(len(word), np.int64)
                np.maximum.at(seen, at, np.concatenate([g[7] for g in got]).astype(np.int64))
                parent = np.full(len(word), 1 / (before.n_words + 1))
                tables = seating.drawn(customers, before.root_tables - seen, parent, STRENGTH, before.root_discount, np.random.default_rng([SEED, sweep, part, 1]), table)
            context, where = np.unique(np.concatenate([g[4] for g in got]), return_inverse=True)
            total, theirs = (np.bincount(where, np.concatenate([g[k] for g in got]), minlength=len(context)).astype(np.int64) for k in (5, 6))
            parts, data, i, k = [], [], 0, 0
            for g in got:
                own, ctx = at[i : i + len(g[1])], where[k : k + len(g[4])]
                i, k = i + len(own), k + len(ctx)
                parts.append(int(g[0][0]))
                data.append(pack_narrow(np.array([part, n_parts]), count[own], customers[own], tables[own], context[ctx], total[ctx], theirs[ctx]))
            sums = [int(count.sum()), int((count > 0).sum()), int((customers == 1).sum()), int((customers == 2).sum()), int(customers.sum()), int(tables.sum())]
            yield batch_of(parts, [REPLY] * len(parts), data, [sums] + [[]] * (len(parts) - 1))

    return lean(run)


def swept(totals: Totals, sweep: int, n_parts: int, hot: Hot):
    """One Gibbs sweep over a partition's dishes; the sample before is kept if it counts."""
    held = max(1, sweep - (SWEEPS - KEPT + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seating.log_stirling(seating.EXACT, totals.discount)
        for part, dishes in settled(batches, held):
            seen = dishes.samples[-1][3]
            tables = dishes.drawn(totals, table, np.random.default_rng([SEED, sweep, part, 0]))
            dishes.samples = [*(dishes.samples if sweep > SWEEPS - KEPT + 1 else []), dishes.fresh(tables)]
            yield from dishes.row(part, n_parts, hot, seen)

    return lean(run)


def settled(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[int, Dishes]]:
    """Partitions' dishes with the root's replies taken in; the live ones, or all where the rows of all pairs are there."""
    seats: dict[int, dict[int, bytes]] = {}
    replies: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind == REPLY:
                replies.setdefault(part, []).append(blob)
            else:
                seats.setdefault(part, {})[kind] = blob
    for part in sorted(seats):
        own = seats.pop(part)
        dishes = Dishes.unpacked(own[SEATS], held, own.get(PAIRS))
        del own
        dishes.told(replies.pop(part, []))
        yield part, dishes


@dataclass
class Model:
    """seats and replies: two rows for each partition (live dishes, all pairs), and one for each of its words' places at the root."""

    seats: DataFrame
    replies: DataFrame
    samples: list[Totals]
    hot: Hot
    n_seen: int
    n_parts: int

    @property
    def n_tokens(self) -> int:
        return self.samples[-1].n_tokens


def kinds_apart(df: DataFrame, path: str) -> DataFrame:
    """written(), with the rows of each kind in a folder of their own, so that those not needed any more can be removed."""
    df.write.mode("overwrite").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def sums_of(rows: DataFrame, n: int) -> list[int]:
    """Sums over partitions, by Spark: one row reaches the driver."""
    got = rows.where(F.size("sums") == n).agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n)]).first()
    return [int(x or 0) for x in got]


def train(docs: DataFrame, at: str, n_parts: int) -> Model:
    """docs: text, and learn, whether it is learned from."""
    spark = docs.sparkSession
    hot, n_seen = hot_words(docs.select("text"), n_parts)
    share = lambda one, two: min(0.95, max(0.05, one / max(1, one + 2 * two)))
    pairs = docs.mapInArrow(counted(n_parts, hot), "part int, data binary").repartition(n_parts, "part")
    state = kinds_apart(pairs.mapInArrow(combined(n_parts, hot), STATE), f"{at}/seats-0")
    pairs = state.where(F.col("kind") == PAIRS).select("part", "kind", "data")
    discount, totals, samples = share(*sums_of(state, 2)), None, []
    for sweep in range(SWEEPS + 1):
        if sweep:
            both = state.where(F.col("kind") == SEATS).union(root).select("part", "kind", "data").repartition(n_parts, "part")
            state = kinds_apart(both.mapInArrow(swept(totals, sweep, n_parts, hot), STATE), f"{at}/seats-{sweep}")
            remove(spark, f"{at}/seats-{sweep - 1}/kind={SEATS}")
            remove(spark, f"{at}/root-{sweep - 1}")
            del both
        up = state.where(F.col("kind") == TO_ROOT).select("part", "data").repartition(n_parts, "part")
        root = written(up.mapInArrow(rooted(sweep, totals, n_parts), STATE), f"{at}/root-{sweep}")
        remove(spark, f"{at}/seats-{sweep}/kind={TO_ROOT}")
        del up
        n_tokens, n_words, one, two, customers, tables = sums_of(root, 6)
        totals = Totals(n_tokens, n_words, discount, totals.root_discount if totals else share(one, two), customers, tables)
        samples = [*(samples if sweep > SWEEPS - KEPT + 1 else []), totals]
        release(spark)
    return Model(state.where(F.col("kind") == SEATS).select("part", "kind", "data").union(pairs), root.select("part", "kind", "data"), samples, hot, n_seen, n_parts)


# -- scoring --------------------------------------------------------------------------------------------------------------


@dataclass
class Places:
    """What scores every pair, a row for each partition; pairs with one of hot_share tokens or more, which are few, are also
    known everywhere: their hashes in order, their words' counts, log10 p(w | u)."""

    rows: DataFrame
    hashes: np.ndarray
    counts: np.ndarray
    logs: np.ndarray


def averaged(samples: list[Totals], customers, tables, total, at, owner, learned: list) -> np.ndarray:
    """log10 of p(w | u), averaged over samples; tables: their sum. learned: of each sample what is known of contexts (their
    tables) and of words (customers and tables at the root), of which the pairs have those at owner and at."""
    p = customers - samples[-1].discount / len(samples) * tables
    for t, k in zip(samples, range(0, len(learned), 3)):
        of_contexts, own, seats = learned[k : k + 3]
        p += t.root(own, seats)[at] * ((STRENGTH + t.discount * of_contexts) / len(samples))[owner]
    p /= (STRENGTH + total)[owner]
    return np.log10(p, out=p)


def placed(model: Model, path: str) -> Places:
    """Seats and replies worked out once for all passes. Hot pairs' contexts are hot as well, so their totals came with the
    replies."""
    least, samples = max(2, model.n_seen / hot_share(model.n_parts)), model.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d in settled(batches, len(samples)):
            tables, learned = np.sum([s[0] for s in d.samples], 0), [x for s in d.samples for x in s[1:]]
            i = np.flatnonzero(d.customers + d.others >= least)
            w, u = d.at[i], d.owner[i]
            logs = averaged(samples, d.customers[i], tables[i], d.total, w, u, learned)
            often = pack(pair_hash(d.context[u], mix(d.word[w])), d.count[w], logs)
            yield batch_of([part] * 2, [PLACED, OFTEN], [pack_narrow(d.word, d.count, d.context, d.each, d.total, d.at, d.customers, tables, *learned), often])

    both = model.seats.union(model.replies).repartition(model.n_parts, "part")
    rows = kinds_apart(both.mapInArrow(lean(run), "part int, kind int, data binary"), path)
    often = [unpack(bytes(r["data"]), np.uint64, np.int64, np.float64) for r in rows.where(F.col("kind") == OFTEN).select("data").collect()]
    hashes, counts, logs = (np.concatenate([x[k] for x in often] or [np.zeros(0, t)]) for k, t in enumerate((np.uint64, np.int64, np.float64)))
    order = np.argsort(hashes)
    return Places(rows.where(F.col("kind") == PLACED), hashes[order], counts[order], logs[order])


SUMS = (np.uint64, np.int64, np.int64, np.float64, np.float64)


def asked(model: Model, hot_table: tuple, n_out: int):
    """Texts to packed rows: tokens by their pair's partition, and a roster with what is known at once."""
    hash_hot, count_hot, log_hot = hot_table
    n, v, n_parts, hot = model.n_tokens, model.samples[-1].n_words, model.n_parts, model.hot
    base_hot = np.log10((count_hot + 0.1) / (n + 0.1 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, ASK):
            rows = piece.num_rows
            ids, valid = piece.column(0).fill_null(0).to_numpy(), piece.column(0).is_valid().to_numpy(zero_copy_only=False)
            row = mix(mix(ids.view(np.uint64)) ^ piece.column(1).to_numpy().view(np.uint64) ^ (~valid).astype(np.uint64))
            known, at, doc = tokens(*buffers(piece.column(2)))
            total = np.bincount(doc, minlength=rows)
            # Tokens by pair, then text; a piece of several texts is of ASK bytes at most, so this is below 1 << 63.
            bits = (rows - 1).bit_length()
            each = pair_keys(known, at)
            each <<= bits
            each |= doc
            del at, doc
            each.sort()
            doc = each & ((1 << bits) - 1)
            each >>= bits
            edge = starts(each)
            keys, times = each[edge], np.diff(np.r_[edge, len(each)])
            del each
            to, apart, hashes = dealt(known, keys, hot, n_parts)
            found, near = isin_sorted(hashes, hash_hot), np.zeros(len(keys), bool)
            near[apart[found]] = True
            met, base, score = (np.zeros(rows) for _ in range(3))
            if found.any():
                own, k = doc[np.repeat(near, times)], np.repeat(np.searchsorted(hash_hot, hashes[found]), times[near])
                met, base, score = (np.bincount(own, x[k], minlength=rows) for x in (count_hot > 0, base_hot, log_hot))
            home = (row % np.uint64(n_out)).astype(np.int64)
            order = order_of(home)
            columns = (row, total, met.astype(np.int64), base, score, ids, valid.view(np.uint8))
            out = [(p, ROSTER, pack(*(c[order[s:e]] for c in columns))) for p, s, e in cut(rows, home[order])]
            far = np.flatnonzero(~near)
            to = to[far]
            order = order_of(to)
            far, runs = far[order], cut(len(far), to[order])
            keys, times, edge = keys[far], times[far], edge[far]
            start = np.r_[0, np.cumsum(times)]
            doc = doc[np.arange(start[-1]) + np.repeat(edge - start[:-1], times)]
            for p, s, e in runs:
                d, theirs = doc[start[s] : start[e]], row
                if len(d) < 4 * rows:  # of more, nearly all texts are met
                    used, d = ranked(d)
                    theirs = row[used]
                out.append((p, ASKED, pack_narrow(*named(known, keys[s:e]), times[s:e], d, theirs)))
            yield batch_of(*(list(x) for x in zip(*out)))

    return lean(run)


def answered(model: Model, n_out: int):
    """A partition's tokens to sums by document; what scores its pairs comes first, rosters pass."""
    samples, n, v = model.samples, model.n_tokens, model.samples[-1].n_words

    def flushed(sums: list) -> Iterator[pa.RecordBatch]:
        row, known, base, score = (np.concatenate(x) for x in zip(*sums))
        row, at = np.unique(row, return_inverse=True)
        known, base, score = (np.bincount(at, x, minlength=len(row)) for x in (known, base, score))
        to = (row % np.uint64(n_out)).astype(np.int64)
        order = order_of(to)
        zero = np.zeros(len(row), np.int64)
        runs = cut(len(row), to[order])
        data = [pack(row[o], zero[o], known[o].astype(np.int64), base[o], score[o]) for o in (order[s:e] for _, s, e in runs)]
        yield batch_of([r[0] for r in runs], [PARTIAL] * len(runs), data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, known, sums, size = None, b"", None, [], 0
        for batch in batches:
            for p, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if p != part:
                    if sums:
                        yield from flushed(sums)
                    part, known, sums, size = p, None, [], 0
                if kind == ROSTER:
                    yield batch_of([p], [kind], [blob])
                elif kind == PLACED:
                    place = blob
                else:
                    if known is None:
                        known, count, contexts, each, total, at, customers, tables, *learned = unpack_narrow(place)
                        owner = np.repeat(np.arange(len(contexts)), each)
                        logs = averaged(samples, customers, tables, total, at, owner, learned)
                        met, base = (count > 0).astype(np.float64), np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
                        keys = owner * len(known) + at
                        del count, total, at, owner, customers, tables, learned
                    word, context, each, w, times, doc, row = unpack_narrow(blob)
                    w = np.searchsorted(known, word)[w]
                    k = np.searchsorted(keys, np.repeat(np.searchsorted(contexts, context) * len(known), each) + w)
                    sums.append((row, *(np.bincount(doc, np.repeat(x, times), minlength=len(row)) for x in (met[w], base[w], logs[k]))))
                    size += len(row)
                    if size > 1_000_000:
                        yield from flushed(sums)
                        sums, size = [], 0
        if sums:
            yield from flushed(sums)

    return lean(run)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rosters and sums of a partition's documents to one row each; rows that are equal share what they have together."""
    roster, sums = [], []
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if kind == ROSTER:
                got = unpack(blob, *SUMS, np.int64, np.uint8)
                roster.append((got[0], got[5], got[6]))
                sums.append(got[:5])
            else:
                sums.append(unpack(blob, *SUMS))
    if not roster:
        return
    row, ids, valid = (np.concatenate(x) for x in zip(*roster))
    keys, at, times = np.unique(row, return_inverse=True, return_counts=True)
    where = [np.searchsorted(keys, s[0]) for s in sums]
    where = np.concatenate(where)
    columns = [np.bincount(where, np.concatenate([s[k] for s in sums]), minlength=len(keys)) / times for k in range(1, 5)]
    total, known = (np.rint(c).astype(np.int64) for c in columns[:2])
    for s in range(0, len(row), 50_000):
        a = at[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 50_000], mask=valid[s : s + 50_000] == 0), pa.array(total[a]), pa.array(known[a]), pa.array(columns[2][a]), pa.array(columns[3][a])], ["id", "n_tokens", "n_known", "base_score", "score"])


def answers(docs: DataFrame, model: Model, passes: int = 1, trained: str | None = None) -> DataFrame:
    """id, n_tokens, n_known, base_score, score of the documents that the model was trained with; docs: id, key, text.

    Rows that are equal are in one pass. The folder ``trained`` isn't needed any more, and removed, before the first.
    """
    spark, n_parts, at = docs.sparkSession, model.n_parts, run_dir(docs.sparkSession, "pitman-yor-scores")
    schema, result = "part int, kind int, data binary", "id long, n_tokens long, n_known long, base_score double, score double"
    places = placed(model, f"{at}/places")
    hot = places.hashes, places.counts, places.logs
    if trained:
        remove(spark, trained)
    release(spark)
    for k in range(passes):
        own = docs.where(F.pmod(F.xxhash64("id", "key"), F.lit(passes)) == k).select("id", "key", "text")
        rows = own.mapInArrow(asked(model, hot, n_parts), schema).union(places.rows)
        sums = rows.repartition(n_parts, "part").sortWithinPartitions("part", "kind").mapInArrow(answered(model, n_parts), schema)
        sums.repartition(n_parts, "part").mapInArrow(summed, result).write.parquet(f"{at}/{k}")
        del rows, sums
        release(spark)
    remove(spark, f"{at}/places")
    return spark.read.schema(result).parquet(*(f"{at}/{k}" for k in range(passes)))


def prepared(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, text, and learn: whether the row is learned from."""
    learn = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != 0, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), learn.alias("learn"))


def scored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = documents.sparkSession
    n_bytes, at = estimated_bytes(documents), run_dir(spark, "pitman-yor")
    n_parts = partitions(spark, 3 * n_bytes, 20 << 20)
    docs = prepared(documents, id_col, text_col)
    model = train(docs.select("text", "learn"), at, n_parts)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    found = answers(docs, model, max(1, min(PASSES, n_bytes // PASS)), at)
    return found.select("id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from nine tenths of them."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
