import pytest

SCHEMA = "doc_id long, text string, id string, key long, data binary, part int, cls string"
WORDS = [f"word{chr(97 + k % 26)}{k}" for k in range(400)]


def prose(seed: int, n: int = 120) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, a NUL and odd characters."""
    long = " ".join(f"{prose(k, 400)}\n" for k in range(60))
    base = prose(1)
    texts = [base, base, base.replace("worda0", "x"), prose(2), prose(2) + " " + prose(3, 30), "", None, "a b", "é 漢字 😀 ▁ \x00 z", long, long + " more", prose(4) + "\n" + prose(1, 60), "one"]
    rows = [(k, t, None if k % 2 else str(k), 7, b"x", k, "c") for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None), (3, prose(9), "other", 1, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
