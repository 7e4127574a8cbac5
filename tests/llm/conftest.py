import pytest

from regolith.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of every odd kind: nulls, empty and long texts, ties and repeats, and columns that clash with inner names."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(30000))
    texts = ["", None, "a", "The MIT license, and more. " * 3, "x y z w v u", "X y Z w v u", long, long + " end", "é ß 漢字 😀", " \n\t ", "the mit license"]
    rows = [(i, t, ["en", None, "fr"][i % 3], None if i == 4 else f"s{i % 2}", 0, "k", i, 1, "p") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "s", 1, "k", 1, 1, "p")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node long, n_words int, _slot string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def sample(spark, sf):
    return table(spark, sf, "documents")
