import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])

#: nulls in every column, empty and blank texts, ties, repeated rows, a very long text, odd characters
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "xx", "s", 4), (4, "one", "en", None, 3),
    (5, "same words in this text here", "en", "s", 28), (6, "same words in this text here", "fr", "t", 28),
    (7, "repeated row", "en", "s", 12), (7, "repeated row", "en", "s", 12), (8, "1234 5678 !!", None, "s", -5),
    (9, "long " * 300_000, "en", "s", 1_500_000), (10, "x" * 40_000, "de", "s", 40_000), (None, "no id here", "en", "s", 10),
    (11, "smile \U0001F600 naïve é <|endoftext|> end", "fr", "s", 40), (12, "a b　c\x00d\x1ce", "en", "s", 9)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with all the odd cases and a column whose name operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, DOCUMENTS).repartition(3, "doc_id")
    for name in ("score", "fp", "key", "bucket", "kept", "term"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def none(spark):
    """Documents without rows."""
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
