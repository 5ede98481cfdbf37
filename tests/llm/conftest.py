import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    from comparo.llm.tables import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def frame(llm):
    """Documents (doc_id, text[, source]) as a table with the columns of `documents` and a few clashing ones."""
    def make(rows, extra=False, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = llm.createDataFrame(full, DOCS).repartition(partitions)
        if extra:
            for name in ("size", "token", "n", "sid", "rid", "sha", "h", "node", "windows", "kept", "hit", "items",
                         "bin", "block", "bucket", "pattern", "members", "toxic", "score", "component_id", "grams"):
                from pyspark.sql import functions as F
                df = df.withColumn(name, F.lit("x"))
        return df
    return make
