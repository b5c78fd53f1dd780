import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hirelens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="hirelens-tests")
    yield s
    s.stop()


def one(spark, expr, value, schema="v string"):
    """Evaluate a Column expression on a one-row frame with column ``v``."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("out")).collect()[0]["out"]
