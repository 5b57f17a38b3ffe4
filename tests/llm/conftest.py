import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows, with extra columns whose names clash."""

    def make(rows):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)
        return df.withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("size", F.lit(-1)).withColumn("fp", F.lit(0)).withColumn("h", F.lit(0)).withColumn("found", F.lit(0))

    return make


SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
