"""Jaccard join of word shingles with two-level PartEnum signatures.

Two documents link when 100 * |A and B| >= similarity * |A or B| over their sets of distinct 5-word shingles. Sets with
equal shingles are one class; classes are what is joined.

1. Sizes fall into bands, so that linked sets lie in one band or in neighbours; a set signs for its own band and, if its
   partners can be that small, for the one below. For a set of size s all partners there differ in k(s) shingles at most.
   The domain of shingles is partitioned by hash into n1 parts, each of those into n2, and a signature is a subset of t
   filled second-level parts of one first-level part, with the shingles that the set has in them; all such subsets are
   enumerated. If a set has more than k(s) + n1 * (t - 1) filled parts, then in some first-level part t of them are the
   same in any partner, so the two share a signature. A pair of which neither set has so many is met by single shingles,
   which such sets sign besides, so no link rests on luck. n1, n2 and t are chosen by band for selective signatures.
2. Classes with a signature in common form a group, and all that are in a group with its smallest class (the leader) form
   that leader's bundle. Linked classes lie in one bundle. Signatures that many sets of a slice of texts have are told by
   one packed row a slice, so that a third of all rows never meet in one task.
3. A bundle's members are compared by sketches, a byte for each part of a coarser partition: sets that differ in d shingles
   differ in d bytes at most. Of those that may link, directly or by others, the whole sets are then compared, and each
   component found is told as links to its smallest class: fewer links than members. Larger bundles than ``BLOCK`` are
   dealt into blocks, and every two blocks meet. A search in breadth looks only at members that aren't reached yet.
4. Links make components.

Shingles are 64-bit hashes, and classes are told apart by 64-bit hashes of their sets.

Defined results: null texts and texts without words have no shingles and link with nothing; under five words make one
shingle; rows that repeat an id share its component; a row with a null id links with nothing and has a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packing import cut, pack, release, unpack
from .util import buffers, estimated_bytes, id_and_text, lean, partitions, pieces, run_dir, SPACES, written

WORDS = 5
#: Bits of a signature for a GB of input; each doubling adds one.
SIG_BITS = 40
#: Above so many sets with a signature in one slice of texts, they travel as one packed row.
MANY = 64
#: Bundles are compared in blocks of so many members, or shingles.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
#: Bits of the filter that picks the texts to be read again: for each wanted one, and at most.
FILTER_BITS, FILTER_MOST = 64, 1 << 26
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (A-Z as a-z): a hash, the index of its text, the place of its last byte, its size."""
    none = np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(raw)]
    first[bounds] = inside[bounds]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(first)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    edge = np.searchsorted(at, start)
    size = np.diff(np.r_[edge, len(at)])
    place = np.arange(len(at)) - np.repeat(edge, size)
    power = np.multiply.accumulate(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(_RANDOM[_LOWER[raw[at]]] * power[place], edge)
    return mix(h ^ size.astype(np.uint64)), np.searchsorted(offsets, start, side="right") - 1, start + size - 1, size


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingles, sorted, and the offsets of each text's."""
    n = len(offsets) - 1
    word, doc, _, _ = words(raw, offsets)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    k = np.uint64(0xD6E8FEB86659FD93)
    m = len(word) - WORDS + 1
    parts, owners = [], []
    if m > 0:
        h = np.zeros(m, np.uint64)
        for i in range(WORDS):
            h = h * k + word[i : i + m]
        whole = doc[:m] == doc[WORDS - 1 :]
        parts.append(mix(h[whole]))
        owners.append(doc[:m][whole])
    for d in np.flatnonzero((count > 0) & (count < WORDS)):  # the whole sequence is one
        h = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for w in word[first[d] : first[d] + count[d]]:
                h = h * k + w
        parts.append(mix(np.array([h], np.uint64)))
        owners.append(np.array([d]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, doc = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=n))]


def class_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each set, from its shingles and size."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    total = np.zeros(n, np.uint64)
    full = size > 0
    if len(h):
        total[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full])
    return mix(total ^ mix(size.astype(np.uint64)))


def most_different(a, b, similarity: int):
    """In how many shingles linked sets of these sizes can differ."""
    return (a + b) * (100 - similarity) // (100 + similarity)


@lru_cache(None)
def plan(lo: int, hi: int, similarity: int) -> tuple[int, int, int] | None:
    """(n1, n2, t) for sets of a band and those of the next that sign for it, or None: single shingles.

    Of the choices that give nearly all sets enough filled parts, and not too many signatures, the most selective one.
    """
    reach = lambda s: s * 100 // similarity
    needed = [(s, most_different(s, partner, similarity)) for s, partner in ((lo, reach(lo)), (hi, reach(hi)), (reach(hi), hi))]
    limit, weight = (max(0.62 if lo < 200 else 0, 0.42 + 14 / lo), 2) if lo > 40 else (0.3 + 40 / lo, 0.5)
    best, found = 0.0, None
    for n2 in (2, 3, 4, 5, 6, 7, 8, 10, 12):
        for t in range(2, min(n2, 5) + 1):
            for n1 in sorted({1, 2, 3, 4, 5, 6, 8, *(max(1, int(lo * x / 20 / n2)) for x in range(6, 40))}):
                n, cost, size = n1 * n2, 0.0, 99.0
                for s, k in needed:
                    empty = np.exp(-s / n)
                    filled, spread = n * (1 - empty), np.sqrt(max(0.0, n * empty * (1 - (1 + s / n) * empty)))
                    if 5 * s < n or filled - 2 * spread - k < n1 * (t - 1) + 1:
                        break
                    cost = max(cost, n1 * comb(n2, t) * (1 - empty) ** t / s)
                    size = min(size, t * s / filled)
                else:
                    if cost <= limit and size - weight * cost > best:
                        best, found = size - weight * cost, (n1, n2, t)
    return found


def bands(similarity: int, size: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Smallest size of each band (and some beyond), the bands' plans and the parts of a sketch's, up to the largest size.

    Smaller sets than the first band's link with equal ones only.
    """
    return bands_up_to(similarity, 1 << int(size.max(initial=1)).bit_length())


@lru_cache(None)
def bands_up_to(similarity: int, most: int) -> tuple[np.ndarray, list, np.ndarray]:
    lo = [1]
    while not most_different(lo[0], lo[0] * 100 // similarity, similarity):
        lo[0] += 1
    while len(lo) < 4 or lo[-3] <= most:
        lo.append(max(100 * lo[-1] // similarity + 1, lo[-1] * 8 // 5 if lo[-1] >= 200 else 0))
    plans = [plan(a, b - 1, similarity) for a, b in zip(lo, lo[1:])]
    return np.array(lo), plans, np.array([max(8, x // 2) for x in lo])


def band_of(size: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set's band, -1 for sets that link with equal ones only, and whether partners can lie in the band below."""
    lo, _, _ = bands(similarity, size)
    band = np.searchsorted(lo, size, side="right") - 1
    return band, (band > 0) & (-(-size * similarity // 100) < lo[np.maximum(band, 0)])


def taken(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some sets, one set after the other, and the index in ``which`` of each."""
    size = np.diff(offsets)[which]
    owner = np.repeat(np.arange(len(which)), size)
    return np.repeat(offsets[which] - np.cumsum(size) + size, size) + np.arange(len(owner)), owner


def sums_of_parts(key: np.ndarray, value: np.ndarray, owner: np.ndarray, n_sets: int, n: int) -> np.ndarray:
    """Sums of the values in each of n parts of each set."""
    total = np.zeros(n_sets * n, np.uint64)
    np.add.at(total, owner * n + ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), value)
    return total.reshape(n_sets, n)


def signatures(h: np.ndarray, offsets: np.ndarray, similarity: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets, see 1 above."""
    size = np.diff(offsets)
    lo, plans, _ = bands(similarity, size)
    band, below = band_of(size, similarity)
    key = mix(h + np.uint64(0x632BE59BD9B4E019))
    value = mix(key ^ np.uint64(0x2545F4914F6CDD1D))
    out_sig, out_set = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in np.unique(np.r_[band[band >= 0], band[below] - 1]).tolist():
        own = np.flatnonzero(band == b)
        which = np.r_[own, np.flatnonzero(below & (band == b + 1))]
        at, owner = taken(offsets, which)
        seed = mix(np.array([b + 1], np.uint64))[0]
        alone = np.ones(len(which), bool)
        if plans[b]:
            n1, n2, t = plans[b]
            total = sums_of_parts(key[at], value[at], owner, len(which), n1 * n2)
            partner = size[which] * 100 // similarity
            partner[len(own) :] = lo[b + 1] - 1
            alone = (total != 0).sum(1) - most_different(size[which], partner, similarity) < n1 * (t - 1) + 1
            full = (total != 0).reshape(-1, n1, n2)
            total = mix(total ^ mix(seed + np.arange(n1 * n2, dtype=np.uint64))).reshape(-1, n1, n2)
            for some in combinations(range(n2), t):
                w, g = np.nonzero(np.logical_and.reduce([full[:, :, c] for c in some]))
                out_sig.append(mix(np.add.reduce([total[w, g, c] for c in some])))
                out_set.append(which[w])
        single = alone[owner]
        out_sig.append(mix(value[at[single]] ^ seed))
        out_set.append(which[owner[single]])
    return np.concatenate(out_sig) >> np.uint64(64 - bits), np.concatenate(out_set)


def sketches(h: np.ndarray, offsets: np.ndarray, similarity: int) -> list[bytes]:
    """A byte for each part of a coarse partition, for the set's band and, if partners can lie there, for the one below.

    Sets that differ in d shingles differ in d parts at most; so pairs with more unequal bytes can't link.
    """
    size = np.diff(offsets)
    band, below = band_of(size, similarity)
    _, _, coarse = bands(similarity, size)
    key = mix(h ^ np.uint64(0x9FB21C651E98DF25))
    value = mix(key)
    out = [b""] * len(size)
    for step, use in ((0, band >= 0), (1, below)):
        for b in np.unique(band[use]).tolist():
            which = np.flatnonzero(use & (band == b))
            at, owner = taken(offsets, which)
            raw = (mix(sums_of_parts(key[at], value[at], owner, len(which), int(coarse[b - step]))) >> np.uint64(56)).astype(np.uint8)
            for k, own in zip(which.tolist(), raw):
                out[k] += own.tobytes()
    return out


SCHEMA = "part int, kind int, id long, n long, cls long, data binary"
MEMBER, CLASS, STAR, LEADER, HOT, PACKED = range(6)


def rows(kind: int, part: np.ndarray | int, length: int, **columns) -> pa.RecordBatch:
    """Rows of SCHEMA; what isn't given is null."""
    kinds = {"id": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "data": pa.binary()}
    part = pa.array(np.broadcast_to(np.asarray(part, np.int32), length))
    own = [columns[c] if c in columns else pa.nulls(length, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays([part, pa.array(np.full(length, kind, np.int32)), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(own, kinds.values()))], ["part", "kind", *kinds])


def groups(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by signature and class without repeats: where groups start (and the end), signatures, classes."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])] if len(sig) else np.zeros(0, bool)
    sig, cls = sig[new], cls[new]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(1, np.int64)
    return edge, sig, cls


def find(similarity: int, n_parts: int, bits: int, many: int):
    """Texts to members, classes, and signatures by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2 << 20):
            h, offsets = shingle_sets(*buffers(part.column(1)))
            cls, size = class_of(h, offsets).view(np.int64), np.diff(offsets)
            yield rows(MEMBER, np.arange(len(cls)) % n_parts, len(cls), id=part.column(0), n=size, cls=cls)
            # Equal sets once, with their smallest id; rows without an id and sets without shingles take no part.
            ids = part.column(0).fill_null(0).to_numpy()
            good = np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False) & (size > 0))
            good = good[np.lexsort((ids[good], cls[good]))]
            good = good[np.r_[True, cls[good][1:] != cls[good][:-1]]] if len(good) else good
            at, _ = taken(offsets, good)
            h, offsets, cls, ids = h[at], np.r_[0, np.cumsum(size[good])], cls[good], ids[good]
            yield rows(CLASS, np.abs(cls % n_parts), len(cls), id=ids, n=np.diff(offsets), cls=cls, data=pa.array(sketches(h, offsets, similarity), pa.binary()))
            sig, owner = signatures(h, offsets, similarity, bits)
            edge, sig, own = groups(sig, cls[owner])
            # Of a signature that very many sets here have, the smallest goes where all its sets meet.
            size = np.diff(edge)
            hot = np.flatnonzero(size > many)
            if len(hot):
                lists = [pack(own[edge[g] : edge[g + 1]]) for g in hot.tolist()]
                name = sig[edge[hot]]
                yield rows(HOT, (mix(name ^ cls.view(np.uint64)[0]) % np.uint64(n_parts)).astype(np.int64), len(hot), id=name.view(np.int64), data=pa.array(lists, pa.binary()))
                keep = ~np.repeat(size > many, size)
                keep[edge[hot]] = True
                sig, own, flag = sig[keep], own[keep], np.repeat(size > many, np.where(size > many, 1, size))
            else:
                flag = np.zeros(len(sig), bool)
            to = (sig % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((own, to))
            to, sig, own, flag = to[order], sig[order], own[order], flag[order].view(np.uint8)
            runs = cut(len(to), to)
            data = []
            for _, s, e in runs:
                some = own[s:e]
                new = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                data.append(pack(sig[s:e], some[new], np.diff(np.r_[new, e - s]).astype(np.uint32), flag[s:e]))
            yield rows(PACKED, np.array([r[0] for r in runs]), len(runs), data=pa.array(data, pa.binary()))

    return lean(run)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's signatures to stars, and the leaders of those that are hot in some slice; classes once."""
    sigs, owners, hots = [], [], []
    known: dict[int, tuple[int, int, bytes]] = {}
    for batch in batches:
        kind = batch.column(1).to_numpy()
        for blob in batch.filter(pa.array(kind == PACKED)).column(5).to_pylist():
            sig, cls, times, hot = unpack(blob, np.uint64, np.int64, np.uint32, np.uint8)
            sigs.append(sig)
            hots.append(sig[hot > 0])
            owners.append(np.repeat(cls, times))
        some = batch.filter(pa.array(kind == CLASS))
        for i, n, cls, data in zip(*(some.column(k).to_pylist() for k in (2, 3, 4, 5))):
            if cls not in known or i < known[cls][0]:
                known[cls] = (i, n, data)
        other = batch.filter(pa.array((kind != PACKED) & (kind != CLASS)))
        if other.num_rows:
            yield other
    keys = list(known)
    for s in range(0, len(keys), 4096):
        own = keys[s : s + 4096]
        ids, n, data = zip(*(known[c] for c in own))
        yield rows(CLASS, 0, len(own), id=pa.array(ids, pa.int64()), n=pa.array(n, pa.int64()), cls=pa.array(own, pa.int64()), data=pa.array(data, pa.binary()))
    known.clear()
    if sigs:
        edge, sig, cls = groups(np.concatenate(sigs), np.concatenate(owners))
        hot = np.flatnonzero(np.isin(sig[edge[:-1]], np.unique(np.concatenate(hots))))
        yield rows(LEADER, 0, len(hot), id=sig[edge[hot]].view(np.int64), cls=cls[edge[hot]])
        size = np.diff(edge)
        follows = np.ones(len(cls), bool)
        follows[edge[:-1]] = False
        stars = np.unique(np.stack([cls[follows], np.repeat(cls[edge[:-1]], size - 1)], 1), axis=0)
        yield rows(STAR, 0, len(stars), id=stars[:, 1], cls=stars[:, 0])


def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders and packed classes to stars."""
    for batch in batches:
        for lead, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cls = unpack(blob, np.int64)[0]
            cls = cls[cls != lead]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), lead, np.int64)), pa.array(cls)], ["lead", "cls"])


def reached(n: int, near) -> Iterator[list[int]]:
    """Components of 0 .. n - 1 by a search in breadth; near(i, rest) says which of the rest i is joined with."""
    rest = np.arange(n)
    while len(rest):
        found, rest = [int(rest[0])], rest[1:]
        done = 0
        while done < len(found) and len(rest):
            hit = near(found[done], rest)
            if hit.any():
                found += rest[hit].tolist()
                rest = rest[~hit]
            done += 1
        yield found


def by_sketch(n: np.ndarray, data: list[bytes], similarity: int):
    """near() for sets of these sizes, in rising order, that the sketches don't rule out."""
    band, below = band_of(n, similarity)
    _, _, coarse = bands(similarity, n)
    first = np.searchsorted(band, np.arange(int(band.max(initial=0)) + 3))
    empty = np.zeros((0, 1), np.uint8)
    own, lower = {}, {}
    for b in np.unique(band[band >= 0]).tolist():
        size, less = int(coarse[b]), int(coarse[b - 1]) if b else 0
        all_ = range(int(first[b]), int(first[b + 1]))
        own[b] = np.frombuffer(b"".join(data[k][:size] for k in all_), np.uint8).reshape(-1, size)
        lower[b] = np.frombuffer(b"".join(data[k][size:].ljust(less, b"\0") for k in all_), np.uint8).reshape(-1, less) if less else empty

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), bool)
        b = int(band[i])
        if b < 0:
            return hit
        edge = np.searchsorted(rest, first[max(b - 1, 0) : b + 3])
        edge = np.r_[edge[0], edge] if b == 0 else edge  # nothing lies below the first band
        mine, mine_lower = own[b][i - first[b]], lower[b][i - first[b]] if below[i] else None
        for k, (side, x) in enumerate(((own, mine_lower), (own, mine), (lower, mine))):
            s, e, at = int(edge[k]), int(edge[k + 1]), b - 1 + k
            if s == e or x is None:
                continue
            some = rest[s:e]
            ok = (n[some] * 100 >= n[i] * similarity) & (n[i] * 100 >= n[some] * similarity)
            if k == 2:
                ok &= below[some]
            some = some[ok]
            differ = (side[at][some - first[at]] != x).sum(1)
            hit[s + np.flatnonzero(ok)[differ <= most_different(n[some], n[i], similarity)]] = True
        return hit

    return near


def by_set(h: np.ndarray, offsets: np.ndarray, similarity: int):
    """near() for sets that link."""
    _, token = np.unique(h, return_inverse=True)
    size = np.diff(offsets)
    mark = np.zeros(int(token.max(initial=0)) + 1, np.int32)
    held = [np.arange(len(size)), token, offsets[:-1]]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) < len(held[0]):
            at, _ = taken(offsets, rest)
            held[:] = rest, token[at], np.cumsum(size[rest]) - size[rest]
        mine = token[offsets[i] : offsets[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[held[1]], held[2])[np.searchsorted(held[0], rest)]
        mark[mine] = 0
        return 100 * both >= similarity * (size[rest] + size[i] - both)

    return near


def keyed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal first columns, which arrive together."""
    held: list[pa.RecordBatch] = []
    last = None

    def closed() -> tuple[tuple, pa.Table]:
        return last, pa.Table.from_batches(held)

    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)], 1)
        edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, m]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            key = tuple(keys[s].tolist())
            if key != last and held:
                yield closed()
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield closed()


def may_link(similarity: int):
    """lead, x, y, cls, n, data by bundle and blocks, to those that may link with another: root says with which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, table in keyed(batches, 3):
            cls, n = table.column(3).to_numpy(), table.column(4).to_numpy()
            order = np.lexsort((cls, n))
            cls, n = cls[order], n[order]
            data = table.column(5).take(pa.array(order)).to_pylist()
            for found in reached(len(cls), by_sketch(n, data, similarity)):
                if len(found) > 1:
                    out += [(*key, found[0], int(cls[k]), int(n[k])) for k in found]
            if len(out) > 10_000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["lead", "x", "y", "root", "cls", "n"])

    return lean(run)


def linked(similarity: int):
    """lead, x, y, root, cls, shingles by the first four, to links of each component with its smallest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in keyed(batches, 4):
            cls, first = np.unique(table.column(4).to_numpy(), return_index=True)  # rows can repeat an id
            raw, offsets = buffers(table.column(5).take(pa.array(first)))
            a, b = [], []
            for found in reached(len(cls), by_set(np.frombuffer(raw.tobytes(), np.uint64), offsets // 8, similarity)):
                low = int(cls[min(found)])
                a += [c for c in cls[found].tolist() if c != low]
                b += [low] * (len(found) - 1)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lean(run)


def filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be one of ``ids``: a bitmap of ``FILTER_MOST`` bits at most is broadcast."""
    n = max(1, min(FILTER_MOST, FILTER_BITS * ids.count()) // 64)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * n))
    bits = ids.select(place("id").alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows_ = docs.withColumn("at", place("id"))
    met = (F.expr("at div 64") == F.col("word")) & (F.expr("shiftrightunsigned(bits, cast(at % 64 as int)) & 1L") == 1)
    return rows_.join(F.broadcast(bits), met, "left_semi").drop("at")


def sets_of(docs: DataFrame) -> DataFrame:
    """cls, shingles (sorted, as bytes) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2 << 20):
            h, offsets = shingle_sets(*buffers(part.column(1)))
            data = h.tobytes()
            own = pa.array([data[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(class_of(h, offsets).view(np.int64)), own], ["cls", "shingles"])

    return docs.select("id", "text").mapInArrow(lean(run), "cls long, shingles binary")


def jaccard_components(documents: DataFrame, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", many: int = MANY, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id for each row."""
    spark = documents.sparkSession
    docs = id_and_text(documents, id_col, text_col)
    n_bytes = estimated_bytes(documents)
    n_parts = partitions(spark, 3 * n_bytes, 24 << 20)
    at = run_dir(spark, "jaccard-join")
    found = docs.mapInArrow(find(similarity, n_parts, min(63, SIG_BITS + (n_bytes >> 30).bit_length()), many), SCHEMA).repartitionById(n_parts, F.col("part")).mapInArrow(lean(meet), SCHEMA)
    found = written(found.drop("part"), f"{at}/found")
    release(spark)
    members = found.where(f"kind = {MEMBER}").select("id", "n", "cls")
    classes = found.where(f"kind = {CLASS}").select("cls", "id", "n", "data")
    leaders = found.where(f"kind = {LEADER}").select(F.col("id").alias("sig"), F.col("cls").alias("lead"))
    hot = found.where(f"kind = {HOT}").select(F.col("id").alias("sig"), "data").join(leaders, "sig").select("lead", "data").mapInArrow(unfolded, "lead long, cls long")
    stars = found.where(f"kind = {STAR}").select(F.col("id").alias("lead"), "cls").union(hot).distinct()
    stars = written(stars.join(classes.select("cls", "n"), "cls").select("lead", "cls", "n"), f"{at}/stars")
    # Bundles with more members, or longer ones, than a task should hold are dealt into blocks.
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    large = stars.groupBy("lead").agg(blocks.alias("blocks")).where("blocks > 1")
    own = stars.select("lead", "cls").union(stars.select("lead", F.col("lead").alias("cls")).distinct()).join(large, "lead", "left")
    own = own.withColumn("block", F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1))))
    pair = F.expr("if(blocks is null, array(named_struct('x', 0L, 'y', 0L)), transform(filter(sequence(0L, blocks - 1), o -> o != block), o -> named_struct('x', least(o, block), 'y', greatest(o, block))))")
    dealt = own.select("lead", "cls", F.explode(pair).alias("p")).select("lead", "p.x", "p.y", "cls").join(classes.select("cls", "n", "data"), "cls").select("lead", "x", "y", "cls", "n", "data")
    near = dealt.repartition(n_parts, "lead", "x", "y").sortWithinPartitions("lead", "x", "y").mapInArrow(may_link(similarity), "lead long, x long, y long, root long, cls long, n long")
    near = written(near, f"{at}/near")
    wanted = classes.join(near.select("cls").distinct(), "cls", "left_semi").select("id")
    sets = sets_of(filtered(docs, wanted))
    met = near.select("lead", "x", "y", "root", "cls").join(sets, "cls").select("lead", "x", "y", "root", "cls", "shingles")
    links = met.repartition(n_parts, "lead", "x", "y", "root").sortWithinPartitions("lead", "x", "y", "root").mapInArrow(linked(similarity), "a long, b long")
    final = written(components(links, f"{at}/components").withColumnRenamed("node", "cls"), f"{at}/final")
    # The smallest id of each component, by class: members of a large component stay spread over its classes.
    low = final.join(classes.select("cls", "id"), "cls").groupBy("component").agg(F.min("id").alias("low"))
    label = classes.select("cls", "id").join(final.join(low, "component").select("cls", "low"), "cls", "left").select("cls", F.coalesce("low", "id").alias("component_id"))
    joined = members.where("id is not null").join(label, "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return joined.union(members.where("id is null").select("id", "n", F.lit(None).cast("long")))


def op6_partenum_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of near-equal documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
