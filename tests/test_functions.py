"""Literal cases of text and time functions, and properties against independent models."""

import difflib
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.functions import text, times
from lumenspan.operators import etl, quality


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalise(spark):
    rows = [("역삼동 a_b², é!",), ("  A  B　C ",), ("",), (None,)]
    assert values(spark, text.normalise(F.col("t")), rows, "t string") == ["역삼동 a_b² é", "a b c", "", None]
    assert values(spark, text.word_count(F.coalesce("t", F.lit(""))), rows, "t string") == [3, 3, 0, 0]


def test_normalise_unicode(spark):
    rows = [("Straße  ＡＢ, c!",), (None,), ("",)]
    assert values(spark, text.normalise_unicode(F.col("t"), "NFKC", True, True), rows, "t string") == ["strasse ab c", None, ""]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("kitten", "sitting", (3, 2, 0, 1)), ("가나다", "가다라", (2, 2, 0, 0)), ("abc", "", (3, 0, 3, 0)), ("", "abc", (3, 0, 0, 3)), ("abcd", "bcde", (2, 0, 1, 1))],
)
def test_edit_counts(a, b, expected):
    assert text.edit_counts(a, b) == expected


@settings(max_examples=150, deadline=None)
@given(st.text("abc가", max_size=12), st.text("abc가", max_size=12))
def test_edits_add_up(a, b):
    d, s, e, i = text.edit_counts(a, b)
    assert d == s + e + i and len(a) - e + i == len(b)


def test_edit_udfs(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "x"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(text.wer(F.col("a"), F.col("b"))).collect()] == [pytest.approx(200 / 3), 100.0, 0.0, None]
    assert [tuple(r[0]) for r in df.select(text.edit_ops(F.col("a"), F.col("b"))).limit(3).collect()] == [text.edit_counts(a, b) for a, b in (("a b c", "a x c d"), ("", "x"), ("", ""))]


def test_similarity_keeps_the_junk_rule(spark):
    rows = [("hello world", "hello word"), ("the quick brown", "quick brown fox"), ("abc", "xyz"), ("", ""), ("ab " * 100, "ba c" * 80)]
    got = values(spark, text.similarity(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == pytest.approx([0.952381, 0.733333, 0, 1, 0], abs=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_length_bound_is_sound(a, b):
    if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
        assert 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b))


def test_cer(spark):
    rows = [("가나다", "가다라"), ("", "abc"), ("abc", "abc")]
    assert values(spark, text.cer(F.col("a"), F.col("b")), rows, "a string, b string") == [pytest.approx(2 / 3), 3.0, 0.0]


def test_clock(spark):
    rows = [("01:02:03,500",), ("00:00:01.25",), ("x",), (None,)]
    assert values(spark, times.clock_seconds(F.col("t")), rows, "t string") == [3723.5, 1.25, None, None]
    assert values(spark, times.clock_text(F.col("s")), [(3723.5,), (59.9996,)], "s double") == ["01:02:03.500", "00:00:60.000"]
    assert values(spark, times.minutes_text(F.col("s")), [(61.9999,)], "s double") == ["01:01.999"]


def test_relative_date(spark):
    rows = [("3시간 전",), ("5분 전",), ("2일 전",), ("2024.01.02.",), (None,)]
    assert values(spark, times.relative_date(F.col("t"), "2024-03-10"), rows, "t string") == ["2024-03-10", "2024-03-10", "2024-03-08", "2024.01.02.", None]


def test_etl_scalars(spark):
    rows = [("강남구 역삼동 1",), ("강남구 테헤란로 5",), (None,)]
    assert values(spark, etl.district(F.col("a")), rows, "a string") == ["역삼동", "역삼동", "기타"]
    assert values(spark, etl.before_dash(F.col("a")), [("공공 -와이파이",), ("x",), (None,)], "a string") == ["공공", "x", None]
    assert values(spark, etl.season(F.col("m")), [(12,), (3,), (9,), (13,)], "m int") == ["winter", "spring", "autumn", "autumn"]
    assert values(spark, etl.to_number(F.col("a")), [(" 3.5 ",), ("1,2",), ("1d",), ("",), ("NaN",), ("-1e3",)], "a string") == [3.5, None, None, None, None, -1000.0]


def test_exclusive_quantiles_match_the_standard_library(spark):
    lists = [[1.0, 2.0, 4.0, 8.0], [3.0, 1.0], [0.1, 0.0, 1.6], [5.0], []]
    df = spark.createDataFrame([(x,) for x in lists], "v array<double>")
    got = df.select(quality.exclusive_quantile(F.col("v"), 1), quality.exclusive_quantile(F.col("v"), 9)).collect()
    for x, r in zip(lists, got):
        q = statistics.quantiles(x, n=10) if len(x) > 1 else [x[0] if x else None] * 9
        assert tuple(r) == (pytest.approx(q[0]), pytest.approx(q[8]))


def test_sums_over_nulls_only_are_zero(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, 5.0, 3)], "k string, x double, y int")
    assert [tuple(r) for r in etl.sum_numeric(df, ["k"]).collect()] == [("a", 0.0, 3)]
