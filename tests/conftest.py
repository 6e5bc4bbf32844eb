import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from maskforge.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def one(spark, col, text):
    """Evaluate a Column function on one string."""
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(col(df["text"]).alias("r")).collect()[0]["r"]
