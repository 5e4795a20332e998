import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs; columns that clash with inner names come along."""

    def make(rows, extra=False):
        df = spark.createDataFrame([tuple(r) for r in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "fp", "key", "score", "n", "items", "cover", "KEY_sha", "kept", "label", "node"):
                df = df.withColumn(name, F.lit(None).cast("string"))
        return df

    return make
