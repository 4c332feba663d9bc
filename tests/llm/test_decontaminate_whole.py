"""All of the benchmark is searched for."""

import random

from lumenspan.llm import decontaminate


def test_parts_of_items_are_found_wherever_they_start():
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(80))
    docs = ["QQ " + item[s : s + 79] + " ZZ" for s in range(len(item) - 79)]
    found = set(decontaminate.Patterns([(0, item)]).search(docs)[0].tolist())
    assert found == set(range(len(docs)))
    # Edits that lie close together: too many for 64 bytes, not for 90.
    assert len(decontaminate.Patterns([(0, item[:90])]).search([item[:40] + "Q" * 8 + item[48:90]])[0])


def test_items_without_an_id_are_searched(spark):
    rng = random.Random(9)
    passages = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(20)) for _ in range(3)]
    items = spark.createDataFrame([(None, passages[0]), (7, passages[1]), (None, passages[2])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + passages[0]), (2, passages[1] + " it"), (None, passages[0]), (4, "nothing of the kind"), (5, passages[2] + " " + passages[0])], "doc_id long, text string")
    found = sorted((r["id"] or 0, r["item_id"] or 0, r["min_edits"]) for r in decontaminate.leaks(docs, items).collect())
    assert found == [(0, 0, 0), (1, 0, 0), (2, 7, 0), (5, 0, 0)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()] == [4]


def test_many_blocks_are_one_pass_with_the_same_rows(spark, monkeypatch):
    """Blocks of a few items, texts in several pieces: the rows of one block, and documents read once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = items.unionByName(items.selectExpr("item_id + 1000 AS item_id", "reverse(text) AS text")).unionByName(spark.createDataFrame([(None, "tiny"), (5000, None)], items.schema))
    rows = lambda: sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())
    whole, kept = rows(), sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect())
    assert len(whole) >= 3 and len(kept) < docs.count()
    monkeypatch.setattr(decontaminate, "BLOCK", 700)
    folder = decontaminate.written_blocks(items, "item_id", "text")
    assert spark.read.parquet(folder).count() > 10
    plan = decontaminate.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Union" not in plan
    assert rows() == whole and sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect()) == kept
