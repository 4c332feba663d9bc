"""Numbers in packed, compressed rows: few rows cross a shuffle, and they hold many numbers each."""

from __future__ import annotations

import gc
import struct
import time

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) as one compressed blob."""
    head, body = [len(arrays)], []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).ravel()
        head.append(len(raw))
        body.append(raw)
    raw = struct.pack(f"<{len(head)}q", *head) + b"".join(body)
    return struct.pack("<q", len(raw)) + _ZSTD.compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds) -> list:
    """What pack() was given; a kind for each array, bytes for bytes."""
    raw = _ZSTD.decompress(memoryview(blob)[8:], struct.unpack_from("<q", blob)[0], asbytes=True)
    n = struct.unpack_from("<q", raw)[0]
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, kinds):
        if kind is bytes:
            out.append(raw[at : at + size])
        else:
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
            out.append(np.empty(planes.shape[1], kind))
            to = out[-1].view(np.uint8).reshape(-1, len(planes))
            for k, plane in enumerate(planes):
                to[:, k] = plane
        at += size
    return out


def cut(n: int, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of the runs of equal values in sorted keys."""
    if not n:
        return []
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return [(int(keys[s]), int(s), int(e)) for s, e in zip(edges[:-1], edges[1:])]


def release(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more.

    The first collection frees plans, the second what they held; files are deleted in between and after.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
