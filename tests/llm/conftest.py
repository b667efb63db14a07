import pytest

EDGE_TEXTS = [None, "", " ", "\n\n", "a", "the cat", "The cat sat on the mat and then it ran away from the dog today again", "é" * 3, "x" * 70_000, "word " * 30_000, "日本語のテキスト", "The cat sat on the mat and then it ran away from the dog today again", "1" * 5000, "<" * 3000, "@" * 3000, "a.b@c.de +1 (017) 555-7713"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, null ids, and columns whose names may clash."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None, 0, i, "x", 1.0, b"s", [1], "h") for i, t in enumerate(EDGE_TEXTS)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, score string, n double, sig binary, spans array<int>, host string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
