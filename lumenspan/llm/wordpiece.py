"""Token counts by a linear longest-match automaton.

Words (split by ASCII white space) are cut greedily into the longest word-piece each: the first from the pieces that
start words, the others from those that continue them. The automaton is a trie of both with failure links: where no
child fits, the link leads to the state reached after the tokens that are sure by now, and how many those are is
precomputed. So each byte is read once and no piece is ever built. All different words of a slice of texts walk the
automaton together, one byte a step.

The vocabulary is that of a SentencePiece model file (pieces with the white-space marker start words).

Defined results: a word that can't be cut is one unknown token; null and empty texts have no tokens; repeated rows are
counted alike; very long texts and words are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .double_array import DoubleArray, model_pieces
from .util import WORD, id_and_text, pieces

MODEL = os.environ.get("LUMENSPAN_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "\u2581"
WORDS = re.compile(WORD.encode())
#: Stands before pieces that continue a word; no UTF-8 text holds it.
CONTINUES = b"\xff"


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that start words, and those that continue them."""
    first, later = set(), set()
    for piece, _, kind in model_pieces(path):
        if kind in (1, 4):
            own = piece[1:] if piece.startswith(MARK) else piece
            if own and MARK not in own:
                (first if piece.startswith(MARK) else later).add(own.encode())
    return first, later


class Automaton:
    def __init__(self, first: set[bytes], later: set[bytes]) -> None:
        trie = self.trie = DoubleArray({k: 1 for k in first} | {CONTINUES + k: 1 for k in later} | {CONTINUES: 0})
        n = len(trie.base)
        self.link, self.popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.again = int(trie.step(np.array([0]), np.array([255]))[0])
        tokens = first | {CONTINUES + k for k in later}
        parent = {c: (p, b) for p in range(len(trie.children)) for b, c in trie.children[p].items()}
        name = {0: b""}
        base, check = trie.base.tolist(), trie.check.tolist()
        link, popped = self.link, self.popped
        for node in trie.order[1:]:
            p, b = parent[node]
            name[node] = name[p] + bytes([b])
            at = trie.place[node]
            if at == self.again:
                continue  # between two pieces: no link
            if name[node] in tokens:
                link[at], popped[at] = self.again, 1
                continue
            u = trie.place[p]
            z, count = int(link[u]), int(popped[u])
            while z != -1 and not (base[z] + b < len(check) and check[base[z] + b] == z):
                z, count = int(link[z]), count + int(popped[z])
            if z != -1:
                link[at], popped[at] = base[z] + b, count
        del trie.place, trie.order, trie.children

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; -1 if it can't be cut."""
        out = np.zeros(len(words), np.int64)
        size = np.array(list(map(len, words)), np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        order = np.argsort(-size, kind="stable")  # longest first, so that those not at their end are in front
        start, size_of = (np.cumsum(size) - size)[order], size[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        step = 0
        while len(alive):
            done = size_of[alive] == step
            if done.any():
                self._finish(alive[done], node, count)
                alive = alive[~done]
                if not len(alive):
                    break
            byte = raw[start[alive] + step]
            todo, dead = alive, []
            while len(todo):
                to = self.trie.step(node[todo], byte)
                hit = to >= 0
                node[todo[hit]] = to[hit]
                todo, byte = todo[~hit], byte[~hit]
                todo, lost, byte = self._fail(todo, node, count, byte)
                dead.append(lost)
            lost = np.concatenate(dead)
            if len(lost):
                count[lost] = -1
                alive = alive[~np.isin(alive, lost)]
            step += 1
        out[order] = count
        return out

    def _fail(self, todo: np.ndarray, node: np.ndarray, count: np.ndarray, byte: np.ndarray):
        link = self.link[node[todo]]
        ok = link >= 0
        lost, todo, byte = todo[~ok], todo[ok], byte[ok]
        count[todo] += self.popped[node[todo]]
        node[todo] = link[ok]
        return todo, lost, byte

    def _finish(self, todo: np.ndarray, node: np.ndarray, count: np.ndarray) -> None:
        while len(todo := todo[node[todo] != self.again]):
            link = self.link[node[todo]]
            count[todo[link < 0]] = -1
            todo, link = todo[link >= 0], link[link >= 0]
            count[todo] += self.popped[node[todo]]
            node[todo] = link


def token_counts(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens (unknown words count one), n_unknown for each document."""
    automaton = Automaton(*vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        tokens = np.zeros(0, np.int64)
        for part in pieces(batches):
            words = [WORDS.findall(t.encode()) for t in part.column(1).to_pylist()]
            if len(known) > 1_000_000:
                known, tokens = {}, np.zeros(0, np.int64)
            before = len(known)
            index = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(words)), np.int64)
            fresh = list(known)[before:]
            if fresh:
                tokens = np.r_[tokens, automaton.counts(fresh)]
            each = np.array(list(map(len, words)), np.int64)
            doc = np.repeat(np.arange(len(words)), each)
            own = tokens[index]
            total = np.bincount(doc, np.where(own < 0, 1, own), minlength=len(words)).astype(np.int64)
            unknown = np.bincount(doc, own < 0, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(each), pa.array(total), pa.array(unknown)], ["id", "n_words", "n_tokens", "n_unknown"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Word-piece lengths of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
