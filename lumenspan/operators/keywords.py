"""Commonest words of cleaned titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keep_letters, split_words


# Particles and common words of news titles.
STOPWORDS = (
    "의", "가", "이", "은", "들", "는", "좀", "잘", "걍", "과", "도", "를", "으로", "자", "에", "와", "한", "하다", "을", "에서", "로", "등", "및", "더", "것", "수", "년", "월", "일",
    "위해", "통해", "대한", "하는", "있는", "있다", "되다", "된다", "많은", "크다", "작다", "좋다", "나쁘다",
)


def keywords(df: DataFrame, text: str, stopwords: Sequence[str] = STOPWORDS, top: int = 20, least: int = 2) -> DataFrame:
    """word, n: words of ``least`` characters or more that aren't stop words; of ties the smaller word."""
    words = df.select(F.explode(split_words(keep_letters(F.col(text)))).alias("word")).where(F.length("word") >= least)
    if stopwords:
        words = words.where(~F.col("word").isin(*stopwords))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
