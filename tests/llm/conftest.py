import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import rows_of  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = "size row key id drop place number window group task n sign path shard slot words text_key word copies bucket score".split()


@pytest.fixture(scope="session")
def rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def awkward(spark, rows):
    """Repeated rows, rows without an id, other rows under a used id, and columns with the operators' inner names."""
    from pyspark.sql import functions as F
    more = rows + rows[:10] + rows[:10] + [(3, "other text under a used id", "en", "s1", 1)] + [
        (None, "no id at all " * 30, "en", None, 2), (None, None, None, None, None)]
    df = spark.createDataFrame(more, COLUMNS)
    return df.withColumns({c: F.lit(c) for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
