import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text[, source]) rows, dealt over partitions."""
    def build(*rows, parts=3):
        full = [(d, t, "en", s[0] if s else "web", len(t or "")) for d, t, *s in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return build


# Cases that every operator has to take: nulls, empty and blank texts, repeated rows and ids.
ODD = [
    (None, None), (None, "lost words without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two words"),
    (5, "x" * 3000), (6, "a b c d e f g h i j k l m n o p " * 40), (7, "a b c d e f g h i j k l m n o p " * 40),
    (8, "é" * 50 + " 漢字    İ"),
]


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture
def clashing(docs):
    """Rows with extra columns whose names operators might use themselves."""
    def build(*rows):
        df = docs(*rows)
        for name in ("id", "component", "mark", "shard", "part", "score", "size", "rank", "taken", "finish", "kept", "_text", "key"):
            df = df.withColumn(name, F.lit("clash"))
        return df
    return build
