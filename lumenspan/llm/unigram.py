"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Blanks become the white-space marker, and one is put in front. Of all cuts of a text into pieces, the one with the
largest sum of log scores is taken; of cuts that tie, at each place the one whose last piece starts first. A character
that no piece of its own covers can be an unknown one, at UNKNOWN below the smallest score, and is then written as its
bytes' pieces. Decoding joins pieces and bytes, turns markers into blanks and drops the one put in front.

Where no piece has a marker behind another character, the best cut of a text is that of its parts, each a run of
markers and what follows to the next; all different parts of a slice of texts are cut together, a byte a step. If the
vocabulary has such pieces, texts are cut whole.

The only public SentencePiece model at hand is a byte-pair one: its scores are merge ranks, not log scores. By default
(``scores="rank"``) a piece of rank r (from 0) gets log(1 / (r + 1)) less the log of the sum over all ranks, Zipf's
law; ``"file"`` takes the file's scores.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; very long texts are encoded
whole; a marker in a text decodes to a blank, all else comes back exactly; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .double_array import DoubleArray, model_pieces
from .util import id_and_text, pieces
from .wordpiece import MARK, MODEL

UNKNOWN = 10.0
MARKER = MARK.encode()
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Parts of more bytes are cut one by one.
LONG = 96


class Unigram:
    """Pieces, scores and the trie; ``encode`` and ``decode`` work on many texts."""

    def __init__(self, path: str = MODEL, scores: str = "rank") -> None:
        vocabulary = model_pieces(path)
        normal = [i for i, (_, _, kind) in enumerate(vocabulary) if kind in (1, 4)]
        self.score = np.zeros(len(vocabulary))
        if scores == "rank":
            best = sorted(normal, key=lambda i: (-vocabulary[i][1], i))
            self.score[best] = -np.log(np.arange(1, len(best) + 1)) - np.log((1 / np.arange(1, len(best) + 1)).sum())
        else:
            self.score[normal] = [vocabulary[i][1] for i in normal]
        self.score = self.score.astype(np.float32).astype(np.float64)  # model files hold single precision
        self.unknown = float(self.score[normal].min()) - UNKNOWN
        self.trie = DoubleArray({vocabulary[i][0].encode(): i for i in normal})
        del self.trie.place, self.trie.order, self.trie.children
        of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == 6}
        unk = next((i for i, v in enumerate(vocabulary) if v[2] == 2), 0)
        self.byte_id = np.array([of_byte.get(b, unk) for b in range(256)], np.int32)
        shown = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() if kind in (1, 4) else b"" for p, _, kind in vocabulary]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array(list(map(len, shown)), np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.is_byte = np.zeros(len(vocabulary), bool)
        self.is_byte[list(of_byte.values())] = True
        self.by_parts = all(MARK not in vocabulary[i][0].lstrip(MARK) for i in normal)

    def _expand(self, part: bytes, ends: list[tuple[int, int, int]]) -> list[int]:
        """Ids of (start, end, id); unknown characters as their bytes."""
        out: list[int] = []
        for s, e, i in ends:
            out += self.byte_id[np.frombuffer(part[s:e], np.uint8)].tolist() if i < 0 else [i]
        return out

    def cut_one(self, part: bytes) -> list[int]:
        """The best cut of one string of bytes."""
        n, base, check, value, score = len(part), self.trie.base, self.trie.check, self.trie.value, self.score
        best, source, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = part[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, k, single = 0, at, False
            while k < n:
                to = base[node] + part[k]
                if check[to] != node:
                    break
                node, k = to, k + 1
                if value[node] >= 0:
                    single |= k - at == size
                    now = best[at] + score[value[node]]
                    if now > best[k]:
                        best[k], source[k], piece[k] = now, at, value[node]
            if not single and best[at] + self.unknown > best[at + size]:
                best[at + size], source[at + size], piece[at + size] = best[at] + self.unknown, at, -1
            at += size
        ends, at = [], n
        while at:
            ends.append((source[at], at, int(piece[at])))
            at = source[at]
        return self._expand(part, ends[::-1])

    def cut_many(self, parts: list[bytes]) -> list[list[int]]:
        """The best cuts of short parts, all at once."""
        n = len(parts)
        size = np.array(list(map(len, parts)), np.int64)
        width = int(size.max(initial=0))
        text = np.zeros((n, width + 1), np.uint8)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        row = np.repeat(np.arange(n), size)
        text[row, np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)] = raw
        char = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)
        best = np.full((n, width + 4), -np.inf)
        source, piece = np.zeros((n, width + 4), np.int16), np.full((n, width + 4), -1, np.int32)
        best[:, 0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(width):
            rows = np.flatnonzero((size > at) & ((text[:, at] & 0xC0) != 0x80))
            if not len(rows):
                continue
            from_here = best[rows, at]
            need = char[text[rows, at]]
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            k = at
            while len(live) and k < width:
                r = rows[live]
                to = base[node] + text[r, k]
                ok = (check[to] == node) & (size[r] > k)
                live, node, r = live[ok], to[ok], r[ok]
                k += 1
                found = np.flatnonzero(value[node] >= 0)
                if len(found):
                    f, r, v = live[found], r[found], value[node[found]]
                    single[f] |= need[f] == k - at
                    now = from_here[f] + self.score[v]
                    better = now > best[r, k]
                    r = r[better]
                    best[r, k], source[r, k], piece[r, k] = now[better], at, v[better]
            bare = np.flatnonzero(~single)
            if len(bare):
                r, to = rows[bare], at + need[bare]
                now = from_here[bare] + self.unknown
                better = now > best[r, to]
                r, to = r[better], to[better]
                best[r, to], source[r, to], piece[r, to] = now[better], at, -1
        # Back from the ends, all at once: one step is one token of each.
        at, live = size.copy(), np.flatnonzero(size > 0)
        steps: list[tuple] = []
        while len(live):
            here = at[live]
            steps.append((live, source[live, here].astype(np.int64), here, piece[live, here]))
            at[live] = steps[-1][1]
            live = live[at[live] > 0]
        out: list[list[int]] = [[] for _ in range(n)]
        for rows, s, e, p in reversed(steps):
            for r, a, b, i in zip(rows.tolist(), s.tolist(), e.tolist(), p.tolist()):
                if i < 0:
                    out[r] += self.byte_id[np.frombuffer(parts[r][a:b], np.uint8)].tolist()
                else:
                    out[r].append(i)
        return out

    def cuts(self, parts: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in parts]
        out: list = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order) and len(raw[order[at]]) <= LONG:
            end = at
            widest = len(raw[order[at]]) + 3
            while end < len(order) and len(raw[order[end]]) <= min(widest, LONG) and end - at < 60_000:
                end += 1
            for i, cut in zip(order[at:end], self.cut_many([raw[i] for i in order[at:end]])):
                out[i] = cut
            at = end
        for i in order[at:]:
            out[i] = self.cut_one(raw[i])
        return out

    def encode(self, texts: list[str], known: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
        """Ids of each text. ``known`` keeps parts' ids between calls."""
        known = {} if known is None else known
        split = PARTS.findall if self.by_parts else lambda t: [t]
        parts = [split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list({p for p in chain.from_iterable(parts) if p not in known})
        for p, ids in zip(fresh, self.cuts(fresh)):
            known[p] = np.array(ids, np.int32)
        none = np.zeros(0, np.int32)
        return [np.concatenate([known[p] for p in own]) if own else none for own in parts]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 bytes of each list of ids."""
        each = np.array(list(map(len, ids)), np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self.shown_size[flat]
        upto = np.cumsum(size)
        k = np.repeat(self.shown_at[flat] - (upto - size), size) + np.arange(int(size.sum()))
        raw = self.shown[k].tobytes()
        ends = np.r_[0, upto][np.cumsum(each)]
        return [raw[a:b].removeprefix(b" ") for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def encode(docs: DataFrame, path: str = MODEL, scores: str = "rank", id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip (the ids decode to
    the text, but for markers in it) and, without ``digest``, token_ids."""
    model = Unigram(path, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for part in pieces(batches, 4 << 20):
            texts = part.column(1).to_pylist()
            if len(known) > 500_000:
                known.clear()
            ids = model.encode(texts, known)
            back = model.decode(ids)
            out = [
                part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([int(model.is_byte[i].sum()) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([b == t.replace(MARK, " ").encode() for b, t in zip(back, texts)]),
            ]
            if not digest:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "token_ids"][: len(out)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean" + ("" if digest else ", token_ids array<int>"))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """id, text of rows (id, token_ids); null ids give a null text, bytes that aren't UTF-8 the replacement character."""
    model = Unigram(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = model.decode([np.array(i or [], np.int32) for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else b.decode(errors="replace") for i, b in zip(ids, back)], pa.string())], ["id", "text"])

    return encoded.select("id", "token_ids").mapInArrow(run, "id long, text string")


def op9_unigram_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces: how many, a checksum, and whether they decode to the text."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("id", "doc_id")
