"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows with quality 1 of the training folds; the unlabelled set is all text of the training
folds, whatever its label. A linear model over ``N_FEATURES`` inputs minimises

    prior * mean_p loss(+) + max(0, mean_u loss(-) - prior * mean_p loss(-))

with the squared loss (1 - z)^2 / 4; where the second part turns negative, its gradient is reversed, as the method has it.
With that loss the risk of all rows, and its gradient, follow from the inputs' first and second moments, which are summed
over every row in one pass; nothing of the unlabelled set is sampled. The class prior is estimated from positives and
unlabelled rows alone, and so are two numbers (slope and offset) that make scores probabilities: both read counts of
margins over all rows. Labels of 0 are never used.

Inputs of a score come from the whole text alone: frequencies of three successive runs of byte classes, and a few
shares (repeated words, repeated 3-word windows, different words, long and short words). Label, language, source and
id are never inputs.

Of the labelled positives ``SAMPLE`` at most are trusted, those with the smallest hash of the id.

Defined results: null and empty texts get the score of all-zero inputs; a null id is in no training fold; ids labelled
twice count with the smaller label; rows that repeat an id count each; without positives every score is 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import WORD, buffers, id_and_text, lean, pieces, run_dir, written

SAMPLE = 20_000
#: Pieces in which matrices are summed; bins of margins, between -LIMIT and LIMIT.
BLOCKS, BINS, LIMIT = 8, 4096, 4.0
RIDGE_ROWS, SCALE = 40, float(1 << 20)
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
WORDS = re.compile(WORD)

# Byte classes.
CLASSES = ("\t\x0b\x0c\r ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&|<>")
N_CLASSES = len(CLASSES) + 2
CLASS_OF = np.full(256, N_CLASSES - 1, np.uint8)
CLASS_OF[128:] = N_CLASSES - 2
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in _chars]] = _k
# Of three successive runs, neighbours differ.
RUN_OF = np.cumsum([a != b != c for a in range(N_CLASSES) for b in range(N_CLASSES) for c in range(N_CLASSES)]) - 1
N_RUNS, N_SHARES = int(RUN_OF[-1]) + 1, 8
N_FEATURES = N_RUNS + N_SHARES


def shares(text: str) -> tuple[float, ...]:
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return (0.0,) * N_SHARES
    windows = set(zip(words, words[1:], words[2:]))
    sizes = list(map(len, words))
    lines = text.split("\n")
    return (
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(windows) / (n - 2) if n > 2 else 0.0,
        min(1.0, len(set(words)) / n**0.8),
        sum(sizes) / n / 10,
        sum(s <= 3 for s in sizes) / n,
        sum(s >= 12 for s in sizes) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(n) / 10),
    )


def features(column: pa.Array) -> np.ndarray:
    """A row of inputs for each text."""
    raw, offsets = buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(raw):
        kind = CLASS_OF[raw].astype(np.int32)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        first = np.ones(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
        kind, doc = kind[first], doc[first]
        three = RUN_OF[(kind[:-2] * N_CLASSES + kind[1:-1]) * N_CLASSES + kind[2:]]
        whole = doc[:-2] == doc[2:]
        counts = np.bincount(doc[:-2][whole] * N_RUNS + three[whole], minlength=n * N_RUNS).reshape(n, N_RUNS)
        out[:, :N_RUNS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    out[:, N_RUNS:] = [shares(t or "") for t in column.to_pylist()]
    return out


@dataclass
class Moments:
    """Mean and mean square of the inputs (with a constant one) over so many rows."""

    n: int
    mean: np.ndarray
    square: np.ndarray


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: Moments, unl: Moments, prior: float, steps: int = 200) -> np.ndarray:
    """Weights that minimise the non-negative risk with squared loss: Newton steps on all rows' moments.

    The ridge is less the more rows there are, and 0.05 at most.
    """
    d = len(unl.mean)
    ridge = min(0.05, max(1e-4, RIDGE_ROWS / unl.n))
    keep = ridge * np.eye(d)
    keep[-1, -1] = 1e-9
    inverse = np.linalg.inv(unl.square / 2 + keep)
    w = np.zeros(d)
    for step in range(steps):
        as_pos = pos.square @ w / 2 - pos.mean / 2  # gradient of mean_p loss(+)
        p_neg, u_neg = pos.square @ w / 2 + pos.mean / 2, unl.square @ w / 2 + unl.mean / 2
        negative = lambda m, v: (v @ m.square @ v + 2 * v @ m.mean + 1) / 4  # noqa: E731  mean loss(-)
        rest = negative(unl, w) - prior * negative(pos, w)
        grad = prior * as_pos + (u_neg - prior * p_neg) + keep @ w if rest >= 0 else -(u_neg - prior * p_neg)
        move = inverse @ grad
        w = w - (1.0 if rest >= 0 and step < 2 else 0.1) * move
        if np.abs(move).max() < 1e-9:
            break
    return w


@dataclass
class Margins:
    """How many rows of the positives and of the unlabelled have a margin in each of BINS bins."""

    centre: np.ndarray
    pos: np.ndarray
    unl: np.ndarray


def estimated_prior(found: Margins) -> float:
    """The class prior: the unlabelled share above a threshold over the positives' share there is never under it, and
    equals it where no negative lies; so the smallest such ratio, with both shares' sampling errors added."""
    p, u = (np.cumsum(x[::-1])[::-1] / max(1, x.sum()) for x in (found.pos, found.unl))
    slack = 1 / np.sqrt(max(1, found.pos.sum()))
    ok = p > 2 * slack
    if not ok.any():
        return 0.5
    ratio = (u[ok] + 1 / np.sqrt(max(1, found.unl.sum()))) / (p[ok] - slack)
    return float(np.clip(u[ok][ratio.argmin()] / p[ok][ratio.argmin()], 0.01, 0.99))


def scaled(found: Margins, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset that make scores probabilities: the non-negative risk of the margins, with logistic loss."""
    p, u = (x / max(1, x.sum()) for x in (found.pos, found.unl))
    x = np.stack([found.centre, np.ones(len(p))], 1)
    ab, m, v = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    for step in range(1, 3001):
        z = x @ ab
        s = sigmoid(z)
        rest = np.logaddexp(0, z) @ (u - prior * p)
        grad = prior * (((s - 1) * p) @ x) + (s * (u - prior * p)) @ x + ridge * ab * [1, 0] if rest >= 0 else -((s * (u - prior * p)) @ x)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        ab = ab - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def inputs(part: pa.RecordBatch, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs with a constant one, whether a trusted positive) of rows (text, positive)."""
    for at in range(0, part.num_rows, step):
        rows = part.slice(at, step)
        x = features(rows.column(0))
        yield np.hstack([x, np.ones((len(x), 1), np.float32)]), rows.column(1).to_numpy(zero_copy_only=False).astype(bool)


SUMS = "part int, positive int, block int, n long, data binary"


def sums(rows: DataFrame) -> DataFrame:
    """Sums for the moments of all rows (0) and of the positives (1) of rows (text, positive): of a task, of tasks, of all."""
    d = N_FEATURES + 1
    upper = np.triu_indices(d)
    cuts = np.linspace(0, len(upper[0]), BLOCKS + 1).astype(int)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, d, d)), [0, 0]
        for batch in batches:
            for part in pieces([batch], 4 << 20):
                for x, positive in inputs(part):
                    for k, own in enumerate((x, x[positive])):
                        if len(own):
                            total[k] += own.T @ own
                            n[k] += len(own)
        if n[0]:
            task = TaskContext.get().partitionId()
            flat = [t[upper].astype(np.float32) for t in total]
            yield from told([(task, k, b, n[k], flat[k][cuts[b] : cuts[b + 1]].tobytes()) for k in (0, 1) if n[k] for b in range(BLOCKS)])

    def told(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], ["part", "positive", "block", "n", "data"])

    def added(first: bool):
        """Tasks' sums come as floats and go on as whole numbers of 2^-20, so that their order makes no difference."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            for batch in batches:
                for k, b, n, data in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
                    own = held.setdefault((k, b), [0, np.int64(0)])
                    own[0] += n
                    own[1] = own[1] + (np.rint(np.frombuffer(data, np.float32).astype(np.float64) * SCALE).astype(np.int64) if first else np.frombuffer(data, np.int64))
            if held:
                yield from told([(0, k, b, n, x.tobytes()) for (k, b), (n, x) in held.items()])

        return run

    each = rows.mapInArrow(lean(summed), SUMS)
    some = each.repartition(4 * BLOCKS, F.pmod("part", F.lit(16)), "block").mapInArrow(added(True), SUMS)
    return some.repartition(BLOCKS, "block").mapInArrow(added(False), SUMS)


def moments(table: pa.Table) -> dict[int, Moments]:
    """Moments of all rows (0) and of the positives (1) from their sums."""
    d, out = N_FEATURES + 1, {}
    for k in (0, 1):
        own = table.filter(pa.compute.equal(table["positive"], k)).sort_by("block")
        if own.num_rows:
            full, n = np.zeros((d, d)), own["n"][0].as_py()
            full[np.triu_indices(d)] = np.frombuffer(b"".join(own["data"].to_pylist()), np.int64) / (SCALE * n)
            full += np.triu(full, 1).T
            out[k] = Moments(n, full[-1].copy(), full)
    return out


def fitted(found: DataFrame, prior: float) -> np.ndarray | None:
    """Weights from sums, worked out in one task, which gets a table of fixed size; None without positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        got = moments(pa.Table.from_batches(held)) if held else {}
        if len(got) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([fit_nnpu(got[1], got[0], prior)], pa.list_(pa.float64()))], ["w"])

    rows = found.repartition(1).mapInArrow(run, "w array<double>").collect()
    return np.array(rows[0]["w"]) if rows else None


def margins(rows: DataFrame, model: Model) -> Margins:
    """Margins of rows (text, positive) in BINS bins between -LIMIT and LIMIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BINS), np.int64)
        for part in pieces(batches, 4 << 20):
            for x, positive in inputs(part):
                at = np.clip((model.margin(x[:, :-1]) + LIMIT) * (BINS / (2 * LIMIT)), 0, BINS - 1).astype(np.int64)
                count[0] += np.bincount(at, minlength=BINS)
                count[1] += np.bincount(at[positive], minlength=BINS)
        used = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[0][used]), pa.array(count[1][used])], ["bin", "unl", "pos"])

    found = rows.mapInArrow(lean(run), "bin long, unl long, pos long").groupBy("bin").agg(F.sum("unl").alias("unl"), F.sum("pos").alias("pos")).collect()
    out = Margins((np.arange(BINS) + 0.5) * (2 * LIMIT / BINS) - LIMIT, np.zeros(BINS), np.zeros(BINS))
    for r in found:
        out.unl[r["bin"]], out.pos[r["bin"]] = r["unl"], r["pos"]
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: id, text. labels: doc_id, quality. Rows of the held-out fold and labels of 0 are never used."""
    learn = fold(F.col("id")) != HELD_OUT
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & learn)
        .groupBy("id").agg(F.min("y").alias("y"))
    )
    trusted = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", F.lit(True).alias("positive"))
    rows = docs.where(learn).join(F.broadcast(trusted), "id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    found = written(sums(rows), f"{run_dir(docs.sparkSession, 'pu-quality')}/sums")
    # With squared loss the unconstrained solution's direction doesn't depend on the prior: its margins tell the prior.
    w = fitted(found, 0.5)
    if w is None:
        return Model(np.zeros(N_FEATURES), 0.0, 0.5)
    seen = margins(rows, Model(w[:-1], float(w[-1]), 0.5))
    prior = estimated_prior(seen)
    w = fitted(found, prior)
    model = Model(w[:-1], float(w[-1]), prior)
    model.slope, model.offset = scaled(margins(rows, model), prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """id, score for each of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 4 << 20):
            for at in range(0, part.num_rows, 2048):
                rows = part.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(features(rows.column(1))), pa.float64())], ["id", "score"])

    return docs.mapInArrow(lean(run), "id long, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores THRESHOLD or more, with all their columns.

    Rows pass through whole, so nulls and repeats in an id do no harm.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 4 << 20, text_col):
            for first in range(0, part.num_rows, 2048):
                rows = part.slice(first, 2048)
                yield rows.filter(pa.array(model.score(features(rows.column(at))) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each document."""
    docs = id_and_text(documents, id_col, text_col)
    out = score(docs, train(docs, labels))
    return out.select("id", F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_pu_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score for each document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
