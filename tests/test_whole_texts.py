"""Queries on text take the whole of it."""

import duckdb
import pytest

from lumenspan.functions import text
from lumenspan.plans import text_queries
from lumenspan.sources import html


def plain_edits(a, b):
    """edit_counts by its table, cell by cell."""
    row = [(j, 0, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [(i, 0, i, 0)]
        for j, y in enumerate(b, 1):
            ways = [(row[j - 1][0] + (x != y), 0, row[j - 1], (x != y, 0, 0)), (row[j][0] + 1, 1, row[j], (0, 1, 0)), (now[j - 1][0] + 1, 2, now[j - 1], (0, 0, 1))]
            cost, _, (_, *old), new = min(ways)
            now.append((cost, *(p + q for p, q in zip(old, new))))
        row = now
    return row[-1]


def conversations(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_edit_ops_of_whole_texts(spark, tmp_path):
    same = "abcdefghij" * 13
    texts = [same + "one end of it", same + "another", same[:125] + "x" * 300, "", "short"]
    d = conversations(spark, tmp_path, [(1, k, "user", t) for k, t in enumerate(texts)])
    got = {r["turn"]: (r["dist"], r["s"], r["d"], r["i"]) for r in text_queries.edit_ops(spark, d).collect()}
    assert got == {k: plain_edits(texts[k - 1], texts[k]) for k in range(1, len(texts))}
    assert got[1][0] > 0 and got[2][0] > 290


def test_edit_counts_choose_as_the_table_does():
    cases = [("abcabcabc" * 20, "acbacb" * 25), ("가나다" * 40 + "x", "나다가" * 41), ("a" * 70, "ba" * 64), ("xy" * 33, "yx" * 65), (["a", "b", "a"] * 30, ["b", "a"] * 40)]
    for a, b in cases:
        assert text.edit_counts(a, b) == plain_edits(a, b)


def test_segments_of_whole_texts(spark, tmp_path):
    same = "word " * 50
    rows = [(1, 0, "user", same + "alpha " * 150), (1, 1, "assistant", same + "other things " * 75), (2, 0, "user", same + "beta"), (2, 1, "assistant", same + "beta"), (3, 0, "user", None), (3, 1, "assistant", "a b")]
    d = conversations(spark, tmp_path, rows)
    diff = {r["file_id"]: (r["word_diff"], r["word_loss_pct"]) for r in text_queries.transcript_diff(spark, d).collect()}
    assert diff == {"1": (0, 0.0), "2": (0, 0.0)}
    patterns = {r["file_id"]: (r["pattern"], r["similarity"]) for r in text_queries.segment_patterns(spark, d).collect()}
    assert patterns["2"] == ("one_to_one", 1.0) and patterns["1"][0] == "text_diff_only" and patterns["1"][1] < 0.95
    stats = {r["file_id"]: r["words"] for r in text_queries.match.transcript_stats(text_queries.srt_of(spark, d, "user")).collect()}
    assert stats == {"1": 200, "2": 51}
    counts = {r["pattern"]: r["n"] for r in text_queries.pattern_counts(spark, d).collect()}
    assert counts == {"text_diff_only": 1, "one_to_one": 1}


def test_references_that_a_page_cuts_short_stay(spark, tmp_path):
    """as in the query's SQL; the operator by itself resolves them as HTML does."""
    page = "<html><body><article><h1>%s</h1><p>one &amp; two</article></body></html>"
    told = ["a&amp;&amp", "b &lt;i&gt; &#x27;&quot;", "&am", "R&D &", "&amp;lt; x"]
    spark.createDataFrame([(k, page % t) for k, t in enumerate(told)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "k", "title", "press", "date", "summary"]
    got = {tuple(r[c] for c in names) for r in text_queries.html_extract(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(con.execute(f"SELECT {', '.join(names)} FROM ({text_queries.ORACLES['html_extract']})").fetchall())
    assert {r[2] for r in got} >= {"a&&amp", "&am", "R&D &", "&lt; x"}
    assert html.page_articles(page % "a&amp;&amp", {"title": "article h1"})[0][0] == "a&&"


@pytest.mark.parametrize("name", ["segment_patterns", "pattern_counts", "segment_report"])
def test_segments_are_worked_out_once(spark, tmp_path, name):
    """what a plan needs of segments, overlaps and text matches several times is read back, not planned again."""
    rows = [(k, t, ("user", "assistant")[t % 2], f"word{k} of {t // 3} and more") for k in range(4) for t in range(6)]
    d = conversations(spark, tmp_path, rows)
    out = getattr(text_queries, name)(spark, d)
    assert len(out.collect()) > 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 12 and plan.count("EvalPython") == 0


def test_left_classes_are_worked_out_once(spark, tmp_path):
    """the counts' plan reads the left segments' classes twice and joins only what nothing matched."""
    rows = [(k, t, ("user", "assistant")[t % 2], f"word{k} of {t // 3} and more") for k in range(4) for t in range(6)]
    d = conversations(spark, tmp_path, rows)
    out = text_queries.pattern_counts(spark, d)
    assert sum(r["n"] for r in out.collect()) == text_queries.segment_patterns(spark, d).count() > 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
