"""Conversations formatted by a compiled template, in pieces, with the places of what a model has to learn; and read back.

Turns are put in order (conversation, turn, role, text) over slices, so a conversation of any length lies in as many tasks
as it needs; how many of its turns earlier slices hold, and whether later ones hold any, is carried into each slice. A task
streams its sorted turns through the template's closures and puts out pieces of bounded size, cut between turns.

Control strings that a text or a role holds are escaped by a backslash after their first character, backslashes by a second
one, so that the format can be read back: ``read`` finds the turns, and the spans are the texts under the loss mask.

Defined results: a null text is an empty one, a null role too; turns without a number come first, repeated numbers in the
order of role and text, repeated rows each count; rows without a conversation are one; empty texts make empty turns and
spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import MOST_SLICES, Slices
from .chat_template import Output, Template
from .packing import pack, unpack
from .util import estimated_bytes, partitions

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TEXT]", "[ROLE]", "[/ROLE]")
# Users stand in [INST], what assistants say after [TEXT], and any other role is named.
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}[TEXT]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)
HELD = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[TEXT\](?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>", re.S)
PIECE = 1 << 20
SCHEMA = "conv_id long, slice int, piece int, whole boolean, n_turns long, formatted string, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KINDS = pa.schema([("conv_id", pa.int64()), ("slice", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", _SPANS)])


def escape(text: str) -> str:
    """No control string is left in the text; ``unescape`` gives it back."""
    return HELD.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}" if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that a formatted text holds."""
    out = []
    for m in TURN.finditer(formatted):
        role, text = (m.lastgroup, m[m.lastgroup]) if m.lastgroup in ("user", "assistant") else (unescape(m["role"]), m["text"])
        out.append((role, unescape(text)))
    return out


def format_chat(conversations: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_chars: int = PIECE, slices: int | None = None) -> DataFrame:
    """conv_id, slice, piece, whole, n_turns, formatted, spans: each conversation in pieces ordered by slice and piece.

    ``whole`` tells that a piece is a conversation's only one. A piece ends after the turn with which it has
    ``piece_chars`` characters. The template is a single loop over ``messages`` (role, text, turn) with text around it;
    ``escape`` is one of its filters.
    """
    empty = F.lit("")
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = slices or min(MOST_SLICES, partitions(rows.sparkSession, estimated_bytes(conversations)))
    cut = Slices(rows, ["conv_id"], ["turn", "role", "hash"], n)
    rows = rows.withColumn("slice", cut.number.cast("int"))
    rows = cut.carried(rows, "slice", {"before": F.count("*")}, {"before": F.sum})
    rows = cut.carried(rows, "slice", {"later": F.count("*")}, {"later": F.sum}, after=True)
    compiled = Template(template, {"escape": escape})
    compiled.over("messages")  # tells of a template that can't be used before any task runs
    source = compiled.source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, each, tail = Template(source, {"escape": escape}).over("messages")
        made, size = [], 0
        for (at, conv), turns in groupby(_turns(batches), key=lambda r: r[:2]):
            env, out = {"conv_id": conv}, Output()
            held = next(turns)
            index, later = held[5], held[6]
            started, piece = index, 0
            if not index:
                head(env, out)
            while held is not None:
                after = next(turns, None)
                each(env, out, {"role": held[3], "text": held[4], "turn": held[2]}, index, after is None and not later)
                index += 1
                if after is None and not later:
                    tail(env, out)
                if after is None or out.size >= piece_chars:
                    made.append((conv, at, piece, not started and after is None and not later, index - started, out.text(), [{"start": a, "end": b} for a, b in out.spans]))
                    size += out.size
                    out, started, piece = Output(), index, piece + 1
                    if size >= piece_chars:
                        yield _batch(made)
                        made, size = [], 0
                held = after
        if made:
            yield _batch(made)

    names = ["slice", "conv_id", "turn", "role", "text", "before", "later"]
    return rows.repartition(n, "slice").sortWithinPartitions("slice", "conv_id", "turn", "role", "hash", "text").select(*names).mapInArrow(run, SCHEMA)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(slice, conv_id, turn, role, text, turns before, turns later)"""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        yield from zip(*cols[:5], (x or 0 for x in cols[5]), (x or 0 for x in cols[6]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _KINDS)], schema=_KINDS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, what is under the loss mask, and sizes.

    A conversation of one piece is digested where it is. Of longer ones the texts, compressed, are streamed in order
    through one task each, as a digest of all of a conversation's bytes needs; pieces are held one at a time.
    """

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, at, piece, whole, _, formatted, spans in zip(*(c.to_pylist() for c in b.columns)):
                turns = read(formatted)
                told = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                row = [conv, at, piece, len(turns), len(loss), len(formatted)]
                out.append((*row, _sha(told), _sha(loss.encode()), None) if whole else (*row, None, None, pack(told, loss.encode())))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["conv_id", "slice", "piece", "n_turns", "loss_chars", "formatted_chars", "turns", "loss", "packed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def of_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for conv, parts in groupby(rows, key=lambda r: r[0]):
            n = chars = size = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            known = None
            for _, _, _, k, loss_chars, formatted, a, b, packed in parts:
                n, chars, size = n + k, chars + loss_chars, size + formatted
                if packed is None:
                    known = a, b
                else:
                    for h, part in zip((turns, loss), unpack(packed, bytes, bytes)):
                        h.update(part)
            a, b = known or (turns.hexdigest(), loss.hexdigest())
            out.append((conv, n, a, chars, b, size))
            if len(out) == 10_000:
                yield _digest_batch(out)
                out = []
        if out:
            yield _digest_batch(out)

    told = pieces.mapInArrow(of_pieces, "conv_id long, slice int, piece int, n_turns long, loss_chars long, formatted_chars long, turns string, loss string, packed binary")
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "piece").mapInArrow(of_conversations, DIGESTS)


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _DIGEST_KINDS)], [x.split()[0] for x in DIGESTS.split(", ")])


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(table.unionByName(more)))
