import pytest
from pyspark.sql import DataFrame


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with an extra column of a clashing name."""

    def make(rows, extra: bool = False) -> DataFrame:
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "'x' as line", "1 as pos", "2 as size", "'y' as start") if extra else df

    return make
