"""Removal of repeated passages by sorted suffixes.

Every byte is removed that a ``window``-byte string covers which also starts in a document with a smaller id.

1. Each window has an anchor, the smallest hash of the 16-byte strings in it; equal windows have equal anchors. Runs of
   windows with one anchor are found per document. Anchors go to partitions by hash, in packed rows, and those that
   occur in two documents or more come back to their documents: only there can a window repeat.
2. The bytes under such runs go to the shard of their anchor. A shard's distinct pieces are sorted by external induced
   sorting (induced_sort.py); neighbours whose common prefix reaches ``window`` hold equal windows, and the smallest id
   of each such group decides.
3. Documents get their intervals back and drop them.

Equal pieces are merged where they arise and again in the shard, so that a passage or document that a third of the rows
share is sorted once; of each set of equal pieces only that with the smallest id needs an answer from the sort. Shards
grow in number with the input. Nothing is sent to the driver or broadcast.

Defined results: a null text is empty; matches never cross documents; rows that repeat an id don't remove each other's
bytes; a row with a null id neither removes nor loses anything; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import sorted_suffixes
from .packing import cut, pack, release, unpack
from .util import buffers, estimated_bytes, lean, partitions, pieces, remove, run_dir, written

GRAM = 16
#: A shard's bytes, roughly; a task holds a few times as much.
SHARD = 12 << 20
PLUS_ONE = bytes([*range(1, 256), 0])  # UTF-8 has no 255


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, odd, step = raw.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(odd) + h[step:]
        odd, step = odd * odd % (1 << 64), 2 * step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, document's index, first and last window start in the whole buffer."""
    none = np.zeros(0, np.int64)
    if len(raw) < window:
        return none.astype(np.uint64), none, none, none
    low, step, width = gram_hashes(raw), 1, window - GRAM + 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    sizes = np.diff(offsets)
    ok = np.zeros(len(low), bool)
    change = np.ones(len(low), bool)
    change[1:] = low[1:] != low[:-1]
    mark = np.zeros(len(low) + 1, np.int32)
    long = sizes >= window
    np.add.at(mark, offsets[:-1][long], 1)
    np.add.at(mark, offsets[1:][long] - window + 1, -1)
    ok = np.cumsum(mark[:-1]) > 0
    change[offsets[:-1][long]] = True
    change[1:] |= ok[1:] != ok[:-1]
    edges = np.flatnonzero(change)
    ends = np.r_[edges[1:], len(low)] - 1
    good = ok[edges]
    first, last = edges[good], ends[good]
    return low[first], np.searchsorted(offsets, first, side="right") - 1, first, last


def find_anchors(window: int, n_parts: int):
    """Texts to packed rows of anchors by partition. kind 0: anchors with one address each; kind 1: addresses that are
    known to repeat, as other documents of the same piece have the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2 << 20):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            raw, offsets = buffers(part.column(2))
            anchor, doc, first, _ = runs(raw, offsets, window)
            if not len(anchor):
                continue
            start = (first - offsets[doc]).astype(np.uint32)
            order = np.lexsort((doc, anchor))
            anchor, doc, start = anchor[order], doc[order], start[order]
            new = np.r_[True, anchor[1:] != anchor[:-1]]
            group = np.cumsum(new) - 1
            ends = np.r_[np.flatnonzero(new)[1:], len(anchor)] - 1
            several = (ids[doc[np.flatnonzero(new)]] != ids[doc[ends]])[group]  # sorted by row; rows of one id may lie apart
            known = np.flatnonzero(several)
            # Of anchors in several documents, one address goes along for others' sake.
            sent = np.flatnonzero(new | ~several)
            out_part, out_kind, out_data = [], [], []
            to = (anchor[sent] % np.uint64(n_parts)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            for p, s, e in cut(len(by), to[by]):
                pick = sent[by[s:e]]
                pick = pick[np.lexsort((start[pick], doc[pick]))]
                out_part.append(p)
                out_kind.append(0)
                out_data.append(pack(anchor[pick], ids[doc[pick]], keys[doc[pick]], start[pick], several[pick].view(np.uint8)))
            if len(known):
                out_part.append(int(anchor[0] % np.uint64(n_parts)))
                out_kind.append(1)
                pick = known[np.lexsort((start[known], doc[known]))]
                out_data.append(pack(ids[doc[pick]], keys[doc[pick]], start[pick]))
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_kind, pa.int32()), pa.array(out_data, pa.binary())], ["part", "kind", "data"])

    return lean(run)


def by_bucket(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Values (one or two numbers a row) of documents, packed in a row for each bucket of documents."""
    to = (ids ^ keys) % n
    order = np.lexsort((keys, ids, to))
    runs = cut(len(to), to[order])
    if runs:
        data = [pack(ids[o], keys[o], values[o].ravel()) for o in (order[s:e] for _, s, e in runs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])


def attached(docs: DataFrame, packed: DataFrame, n: int) -> DataFrame:
    """Documents and what is packed for them, bucket by bucket, the packed rows first."""
    docs = docs.withColumns({"bucket": F.coalesce(F.pmod(F.col("id").bitwiseXOR(F.col("key")), F.lit(n)), F.pmod("key", F.lit(n))), "data": F.lit(None).cast("binary")})
    return docs.unionByName(packed, allowMissingColumns=True).repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions(F.col("data").isNull()).drop("bucket")


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Slices of a bucket's documents, and what is packed for them by (id, key)."""
    got, table = [], None
    for batch in batches:
        data = batch.column(batch.schema.get_field_index("data"))
        got += [unpack(b, np.int64, np.int64, np.uint32) for b in data.drop_null().to_pylist()]
        docs = batch.filter(data.is_null())
        if not docs.num_rows:
            continue
        if table is None:
            table = {}
            if got:
                ids, keys, values = (np.concatenate(x) for x in zip(*got))
                values = values.reshape(len(ids), -1)
                order = np.lexsort((keys, ids))
                ids, keys, values = ids[order], keys[order], values[order]
                edges = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]), True])
                table = {(i, k): values[s:e] for i, k, s, e in zip(ids[edges[:-1]].tolist(), keys[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist())}
                got = []
        for part in pieces([docs], 2 << 20):
            yield part, table


def repeated_anchors(n_parts: int):
    """A partition's anchors to the addresses of those that two documents have, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, known = [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    known.append(unpack(blob, np.int64, np.int64, np.uint32))
                else:
                    got.append(unpack(blob, np.uint64, np.int64, np.int64, np.uint32, np.uint8))
        if got:
            anchor, ids, keys, start, several = (np.concatenate(x) for x in zip(*got))
            del got
            order = np.argsort(anchor, kind="stable")
            anchor = anchor[order]
            edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sorted_ids = ids[order]
            often = (np.minimum.reduceat(sorted_ids, edges) != np.maximum.reduceat(sorted_ids, edges)) | (np.maximum.reduceat(several[order], edges) > 0)
            del anchor, sorted_ids
            # An address sent for an anchor that is known to repeat was also sent as known.
            pick = order[np.repeat(often, np.diff(np.r_[edges, len(order)]))]
            pick = pick[several[pick] == 0]
            known.append([ids[pick], keys[pick], start[pick]])
        if known:
            yield from by_bucket(*(np.concatenate(x) for x in zip(*known)), n_parts)

    return lean(run)


def cut_pieces(window: int, n_parts: int):
    """Texts and their repeated anchors' addresses to packed rows by shard: kind 0 pieces, kind 1 intervals known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, marks in looked_up(batches):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            raw, offsets = buffers(part.column(2))
            anchor, doc, first, last = runs(raw, offsets, window)
            if not len(anchor):
                continue
            wanted = [marks[x][:, 0].astype(np.int64) + at for x, at in zip(zip(ids.tolist(), keys.tolist()), offsets[:-1].tolist()) if x in marks]
            if not wanted:
                continue
            pick = np.flatnonzero(np.isin(first, np.concatenate(wanted)))
            start = first - offsets[doc]
            pick = pick[np.argsort(ids[doc[pick]], kind="stable")]  # smallest ids first
            text = raw.tobytes()
            seen: dict[bytes, int] = {}
            own, gone = [], []
            for k, i, s, e in zip(pick.tolist(), ids[doc[pick]].tolist(), first[pick].tolist(), (last[pick] + window).tolist()):
                (own if seen.setdefault(text[s:e], i) == i else gone).append(k)
            own, gone = np.array(own, np.int64), np.array(gone, np.int64)
            shard = (anchor[own] % np.uint64(n_parts)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            parts, kinds, data = [], [], []
            for p, s, e in cut(len(by), shard[by]):
                some = own[by[s:e]]
                parts.append(p)
                kinds.append(0)
                data.append(pack(ids[doc[some]], keys[doc[some]], start[some].astype(np.uint32), (last[some] - first[some] + window).astype(np.uint32), b"".join([text[a:b] for a, b in zip(first[some].tolist(), (last[some] + window).tolist())])))
            if len(gone):
                parts.append(int(anchor[gone[0]] % np.uint64(n_parts)))
                kinds.append(1)
                data.append(pack(ids[doc[gone]], keys[doc[gone]], np.stack([start[gone], start[gone] + last[gone] - first[gone] + window], 1).astype(np.uint32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])

    return lean(run)


def sort_shard(window: int, n_parts: int):
    """A shard's pieces to the intervals that documents lose, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, lost = [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    ids, keys, pairs = unpack(blob, np.int64, np.int64, np.uint32)
                    lost.append((ids, keys, pairs.reshape(-1, 2)))
                else:
                    got.append(unpack(blob, np.int64, np.int64, np.uint32, np.uint32, bytes))
        if got:
            lost.append(lost_in(got, window))
        if lost:
            yield from by_bucket(*(np.concatenate(x) for x in zip(*lost)), n_parts)

    return lean(run)


def lost_in(got: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, intervals) that the documents of a shard's pieces (ids, keys, starts, sizes, bytes) lose."""
    ids, keys, start, size = (np.concatenate(x) for x in list(zip(*got))[:4])
    text = b"".join(g[4] for g in got)
    got.clear()
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    seen: dict[bytes, int] = {}
    own, gone = [], []
    for k in np.argsort(ids, kind="stable").tolist():
        (own if seen.setdefault(text[begins[k] : ends[k]], ids[k]) == ids[k] else gone).append(k)
    seen.clear()
    gone, own = np.array(gone, np.int64), np.array(own, np.int64)
    pairs = [(gone, start[gone], start[gone] + size[gone])]
    # The shard's text: every byte plus one, a 0 after each piece.
    sizes = size[own].astype(np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    text = text.translate(PLUS_ONE)
    shard = np.frombuffer(b"\0".join([text[a:b] for a, b in zip(begins[own].tolist(), ends[own].tolist())]) + b"\0", np.uint8)
    del text
    piece = np.repeat(np.arange(len(own), dtype=np.int32), sizes + 1)
    whole = np.ones(len(shard), bool)  # a window starts here
    for back in range(window):
        whole[np.maximum(at + sizes - back, 0)] = False
    own_ids = ids[own]
    repeated = np.zeros(len(shard), bool)

    def close(pos: np.ndarray, lcp: np.ndarray) -> None:
        """Groups of equal windows in a block that starts and ends with a group."""
        who = own_ids[piece[pos]]
        edges = np.flatnonzero(lcp < window)
        low = np.minimum.reduceat(who, edges)
        repeated[pos[who > np.repeat(low, np.diff(np.r_[edges, len(pos)]))]] = True

    tail_pos, tail_lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for pos, lcp in sorted_suffixes(shard, window):
        ok = whole[pos]
        # Suffixes without a whole window have a smaller common prefix with all that have one.
        pos, lcp = np.r_[tail_pos, pos[ok].astype(np.int64)], np.r_[tail_lcp, lcp[ok]]
        edges = np.flatnonzero(lcp < window)
        if not len(edges) or edges[-1] == 0:
            tail_pos, tail_lcp = pos, lcp
            continue
        close(pos[: edges[-1]], lcp[: edges[-1]])
        tail_pos, tail_lcp = pos[edges[-1] :], lcp[edges[-1] :]
    if len(tail_pos):
        tail_lcp[0] = 0
        close(tail_pos, tail_lcp)
    lost = np.flatnonzero(repeated)
    if len(lost):
        breaks = np.flatnonzero(np.r_[True, np.diff(lost) > 1])
        first, last = lost[breaks], lost[np.r_[breaks[1:] - 1, len(lost) - 1]]
        which = piece[first]
        k = own[which]
        pairs.append((k, start[k] + first - at[which], start[k] + last - at[which] + window))
    k, a, b = (np.concatenate(x) for x in zip(*pairs))
    return ids[k], keys[k], np.stack([a, b], 1).astype(np.uint32)


def merged(pairs: np.ndarray) -> np.ndarray:
    """Sorted intervals without overlap; those that touch become one."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")].astype(np.int64)
    upto = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > upto[:-1]]
    return np.stack([pairs[new, 0], upto[np.r_[np.flatnonzero(new)[1:] - 1, len(pairs) - 1]]], 1)


def lost_intervals(docs: DataFrame, window: int, n_parts: int) -> DataFrame:
    """bucket, data (packed ids, keys, intervals) for docs (id, key, text)."""
    spark = docs.sparkSession
    at = run_dir(spark, "suffix-dedup")
    given = docs.where("id is not null")
    schema, packed = "part int, kind int, data binary", "bucket long, data binary"
    anchors = given.mapInArrow(find_anchors(window, n_parts), schema).repartitionById(n_parts, F.col("part"))
    marks = written(anchors.mapInArrow(repeated_anchors(n_parts), packed), f"{at}/marks")
    del anchors  # its plan holds on to the shuffle's files
    release(spark)
    parts = attached(given, marks, n_parts).mapInArrow(cut_pieces(window, n_parts), schema).repartitionById(n_parts, F.col("part"))
    lost = written(parts.mapInArrow(sort_shard(window, n_parts), packed), f"{at}/lost")
    del parts, marks
    remove(spark, f"{at}/marks")
    release(spark)
    return lost


def remove_repeats(documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", kept: str = "sha256") -> DataFrame:
    """All columns of the documents, and n_bytes, n_removed, n_spans and, as ``kept`` says, kept_sha256 or kept_text.

    kept_text drops what is left of characters that an interval cuts.
    """
    own = [f"c{i}" for i in range(len(documents.columns))]
    docs = documents.select(
        F.struct(*(F.col(c).alias(o) for c, o in zip(documents.columns, own) if c != text_col)).alias("rest"),
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("no_text"),
    )
    n_parts = partitions(documents.sparkSession, 3 * estimated_bytes(documents), SHARD)
    lost = lost_intervals(docs.select("id", "key", "text"), window, n_parts)
    joined = attached(docs, lost, n_parts).select("rest", "id", "key", "text", "no_text", "data")
    as_text = kept != "sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lost in looked_up(batches):
            found = [lost.get(x) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            texts = part.column(3).to_pylist()
            n_bytes, n_removed, n_spans, result = [], [], [], []
            for text, blob, none in zip(texts, found, part.column(4).to_pylist()):
                raw = text.encode()
                gone = merged(np.zeros((0, 2), np.int64) if blob is None else blob)
                n_bytes.append(len(raw))
                n_removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                n_spans.append(len(gone))
                if len(gone):
                    edges = [0, *gone.ravel().tolist(), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                result.append((None if none else raw.decode(errors="ignore")) if as_text else hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(result, pa.string())], ["rest", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    rest = docs.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(run, f"rest {rest}, n_bytes long, n_removed long, n_spans long, kept string")
    return out.select(*(F.col(f"rest.{o}").alias(c) if c != text_col else F.col("kept").alias(c) for c, o in zip(documents.columns, own) if c != text_col or as_text), "n_bytes", "n_removed", "n_spans", *([] if as_text else [F.col("kept").alias("kept_sha256")]))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What each document loses to repeated 50-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
