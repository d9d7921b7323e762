import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
#: Names that operators use inside.
CLASHES = ["id", "tag", "own", "place", "line", "key", "fp", "node", "row", "hash", "n", "u", "v", "rules", "score", "keys", "body",
           "trusted_id", "leaky_id", "w", "bucket", "component_id", "fingerprint", "component", "salt", "kept", "rank", "label", "h1"]

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma{i * i % 101}" for i in range(40))
EDGE = [
    (1, BASE + "\nA line that stands in several documents, unchanged."), (2, BASE + "\nA line that stands in several documents, unchanged."),
    (3, BASE.replace("alpha3 ", "delta ") + "\nA line that stands in several documents, unchange."), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "),
    (7, LONG), (8, "one"), (9, "one two"), (9, "one two"), (None, "a text without an id"), (None, None), (10, "été 日本 😀 \x00 ﬁ ſ K"),
    (11, "A line that stands in several documents, unchanged.\n\nx\nx"), (12, "same same same same same same"), (7, "another text with that id")]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return EDGE
