import pytest

ODD = [
    (1, "Plain words stand here, one after another, and end.", "en"),
    (1, "Plain words stand here, one after another, and end.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "  \n\n \t ", "en"),
    (None, "A row without an id, with words enough to be read.", "en"),
    (5, "x" * 5000 + " " + "word " * 3000, "de"),
    (6, "Ünïcödé téxt – mit Zeichen 漢字 \U0001f600 und mehr", "xx"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return base.select("*", F.lit("clash").alias("id"), F.lit("clash").alias("key"), F.lit(7).alias("n_lines"), F.lit(7).alias("fp"), F.lit("c").alias("component"), F.lit(1).alias("part"))


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*texts, start=0):
        return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    return make
