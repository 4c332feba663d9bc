"""A double-array trie over byte strings, and the pieces of a SentencePiece model file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

ROOT = 0


class DoubleArray:
    """Child of node s by byte b: t = base[s] + b, if check[t] == s. value[t] is the key's number, or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        number = [-1]
        for key, n in keys.items():
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    number.append(-1)
                at = children[at][b]
            number[at] = n
        size = 2 * len(children) + 512
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        check[0] = -2
        value[0] = number[0]
        free, place = 1, {0: ROOT}
        order = [0]
        for node in order:  # nodes by depth
            own = sorted(children[node].items())
            if not own:
                base[place[node]] = size  # no child: every place lies past the end
                continue
            while used[free]:
                free += 1
            at, tries = max(1, free - own[0][0]), 0
            while any(used[at + b] for b, _ in own):
                at, tries = at + 1, tries + 1
                if at + 256 >= len(used):
                    used.extend(bytes(size))
                if tries == 4000:  # a crowded start isn't worth more search
                    free, tries = free + 1000, 0
                    while used[free]:
                        free += 1
                    at = max(at, free)
                    if at + 256 >= len(used):
                        used.extend(bytes(size))
            while at + 256 >= len(check):
                base, check, value = np.r_[base, np.zeros(size, np.int32)], np.r_[check, np.full(size, -1, np.int32)], np.r_[value, np.full(size, -1, np.int32)]
            s = place[node]
            base[s] = at
            for b, child in own:
                used[at + b] = 1
                check[at + b], value[at + b] = s, number[child]
                place[child] = at + b
                order.append(child)
        end = int(np.flatnonzero(check != -1).max()) + 1
        self.base, self.check, self.value = base[:end], np.r_[check[:end], np.full(256, -1, np.int32)], value[:end]
        self.base[self.base == size] = end
        self.place, self.order, self.children = place, order, children

    def __getstate__(self) -> dict:
        return {"base": self.base, "check": self.check, "value": self.value}

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children by byte, or -1."""
        to = self.base[node] + byte
        return np.where(self.check[to] == node, to, -1)


def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            got, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            got, at = raw[at : at + size], at + size
        yield tag >> 3, got


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id. Types: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
    out = []
    with open(path, "rb") as f:
        for number, message in fields(f.read()):
            if number == 1:
                own = dict(fields(message))
                out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
    return out
