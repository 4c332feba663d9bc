"""Ordered scans over slices, so that no task holds a whole key.

Rows are ordered by key and then by what orders a key's rows. ``Slices`` cuts that order at bounds, so that a hot key lies
in many slices. What a slice tells those after it (its last row, its largest end, a count) is a row for each key that
crosses a bound, a row a slice at most; these rows are folded in order and carried into the slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BYTES = 64 << 20
MOST_SLICES = 10_000


def slice_count(df: DataFrame, each: int = SLICE_BYTES) -> int:
    """Slices of about ``each`` bytes by the optimizer's sizes of what the plan reads; 1 where they are unknown."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return max(1, min(MOST_SLICES, -(-sum(x for x in sizes if x < 1 << 60) // each)))


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Slices:
    """Bounds of a table's order by ``keys`` and ``order``, nulls first; rows that are equal in all of them stay together.

    The bounds are literals, so every plan that uses ``number`` puts a row in the same slice.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int):
        self.keys, self.order, self.n = list(keys), list(order), n
        cols = [*self.keys, *self.order]
        kinds = [df.schema[c].dataType.simpleString() for c in cols]
        at = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(cols)))
        low = df.select(at.alias("at")).repartitionByRange(n, "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("at"))
        rows = low.select("p", *(F.col(f"at.c{k}").cast("string") for k in range(len(cols)))).collect()  # a row a slice
        told = [", ".join(f"CAST({_quoted(v)} AS {kind}) AS c{k}" for k, (v, kind) in enumerate(zip(row[1:], kinds))) for row in sorted(rows)[1:]]
        self.size = len(told)
        self._bounds = F.array_sort(F.expr("array(" + ", ".join(f"struct({x})" for x in told) + ")")) if told else None
        self._at = at

    @property
    def number(self) -> Column:
        """The number of bounds that are at most the row, by bisection."""
        if self._bounds is None:
            return F.lit(0)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(self.size.bit_length()))))
        ahead = lambda at, step: (at + step <= self.size) & (F.get(self._bounds, at + step - 1) <= self._at)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))

    def crosses(self, number: Column) -> Column:
        """Whether the row's key may lie in more than one slice: a bound of its slice has that key."""
        if self._bounds is None:
            return F.lit(False)
        same = lambda k: F.coalesce(_all([F.get(self._bounds, k)[f"c{i}"].eqNullSafe(F.col(c)) for i, c in enumerate(self.keys)]), F.lit(False)) & (k >= 0) & (k < self.size)
        return same(number - 1) | same(number)

    def carried(self, rows: DataFrame, number: str, told: dict[str, Column], fold: dict[str, Callable[[Column], Column]], after: bool = False) -> DataFrame:
        """``rows`` with what the key's earlier slices (later ones if ``after``) tell, folded in their order; null where there are none.

        told: an aggregate for each name over the rows of a key in a slice; fold: how the slices' values make one, such as
        ``F.max``. ``number`` is the column with ``self.number``.
        """
        part = rows.where(self.crosses(F.col(number))).groupBy(*self.keys, number).agg(*(c.alias(k) for k, c in told.items()))
        w = Window.partitionBy(*self.keys).orderBy(F.desc(number) if after else F.asc(number)).rowsBetween(Window.unboundedPreceding, -1)
        names = [*self.keys, number]
        part = part.select(*(F.col(c).alias(f"_at{i}") for i, c in enumerate(names)), *(fold[k](F.col(k)).over(w).alias(k) for k in told))
        same = _all([F.col(f"_at{i}").eqNullSafe(F.col(c)) for i, c in enumerate(names)])
        return rows.join(F.broadcast(part), same, "left").drop(*(f"_at{i}" for i in range(len(names))))  # two rows a slice at most


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
