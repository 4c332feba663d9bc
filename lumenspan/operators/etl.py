"""Projections and aggregations of tabular extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import private
from .selection import quantiles

SEASONS = ("spring", "summer", "autumn", "winter")
# Districts by road, tried in this order.
ROADS = (
    ("테헤란로", "역삼동"), ("강남대로", "역삼동"), ("언주로", "논현동"), ("봉은사로", "삼성동"), ("영동대로", "삼성동"), ("선릉로", "역삼동"), ("도곡로", "도곡동"), ("개포로", "개포동"), ("양재천로", "양재동"),
    ("학동로", "논현동"), ("압구정로", "압구정동"), ("남부순환로", "도곡동"), ("헌릉로", "일원동"), ("광평로", "수서동"), ("밤고개로", "수서동"), ("개포동", "개포동"), ("자곡로", "자곡동"),
)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def select_renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the columns that ``names`` lists, under their new names; a missing one is an error."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def to_number(value: Column) -> Column:
    """A number, or null where the text isn't one; NaN becomes null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def cast_columns(df: DataFrame, names: Sequence[str] | None = None, but: Sequence[str] = ()) -> DataFrame:
    """Coerce the named columns, or all except ``but``, to numbers."""
    chosen = list(names) if names is not None else [c for c in df.columns if c not in set(but)]
    return df.withColumns({c: to_number(F.col(c)) for c in chosen})


def ordered_lookup(value: Column, pattern: str, table: Sequence[tuple[str, str]], default: str) -> Column:
    """The first group of ``pattern``, else the value of the first table entry that the text contains, else ``default``."""
    text = F.coalesce(value, F.lit(""))
    found = F.regexp_extract(text, pattern, 1)
    out = F.when(found != "", found)
    for part, result in table:
        out = out.when(text.contains(part), F.lit(result))
    return out.otherwise(F.lit(default))


def district(address: Column) -> Column:
    """The district that an address names, or that of its road; null and others are "기타"."""
    return ordered_lookup(address, r"([\p{L}\p{N}_]+동)", ROADS, "기타")


def before_dash(value: Column) -> Column:
    """What stands before the first dash, trimmed; without a dash the value itself."""
    return F.when(value.contains("-"), F.trim(F.split_part(value, F.lit("-"), F.lit(1)))).otherwise(value)


def season(month: Column) -> Column:
    """Northern season of a month number; anything else counts as autumn, null too."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def season_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEASONS)), name)


def sum_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of all numeric columns by keys: rows with a null key are left out, a sum over nulls only is 0."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric))


def value_counts(df: DataFrame, name: str, top: int | None = None, by_key: bool = False) -> DataFrame:
    """Rows for each non-null value: the commonest first (ties by value), or by value; ``top`` keeps the first ones."""
    out = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    out = out.orderBy(name) if by_key else out.orderBy(F.desc("n"), name)
    return out.limit(top) if top is not None else out


def describe(df: DataFrame, names: Sequence[str], slices: int | None = None) -> DataFrame:
    """name, n, mean, std, lowest, exact quartiles q1 to q3 and highest of each column, a row for each.

    Quartiles are found by selection: no task sorts or holds a column.
    """
    row = df.agg(*(F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest")).alias(f"c{i}") for i, c in enumerate(names)))
    told = row.select(F.inline(F.array(*(f"c{i}" for i in range(len(names))))))
    return told.join(quantiles(df, names, (0.25, 0.5, 0.75), slices), "name", "left").select("name", "n", "mean", "std", "lowest", "q1", "q2", "q3", "highest")


def unnest_tagged(df: DataFrame, arrays: dict[str, str], keys: Sequence[str], value: str, tag: str = "type") -> DataFrame:
    """A row for each element of several arrays, tagged with its array."""
    packed = F.explode(F.array(*(F.struct(F.lit(t).alias(tag), F.col(c).alias("v")) for c, t in arrays.items()))).alias("s")
    return df.select(*keys, packed).select(*keys, F.col(f"s.{tag}").alias(tag), F.explode("s.v").alias(value))


def pivot_sum(df: DataFrame, row: str, key: str, values: Sequence, measures: Sequence[str]) -> DataFrame:
    """Sums of each measure by row and key value, wide; what is absent is 0. ``values`` fixes the columns."""
    out = df.groupBy(row).pivot(key, list(values)).agg(*(F.sum(m).alias(m) for m in measures))
    return out.na.fill(0)


def pivot_count(df: DataFrame, row: str, key: str, values: Sequence, counted: str) -> DataFrame:
    """Counts of a non-null column by row and key value, with fixed columns in fixed order; what is absent is 0."""
    return df.groupBy(row).pivot(key, list(values)).agg(F.count(counted)).na.fill(0)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_at")).orderBy("first_at", key)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each key, for the samples that a report shows; ties by all of ``order``."""
    rank = private(df, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n).drop(rank)


def shares_of_total(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each row's percentage of its group's total; null where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share_pct", 100 * F.col(value) / F.when(total != 0, total))
