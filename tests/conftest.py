import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__  # noqa: E402,F401  (makes workers independent of the folder)
from answerloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, "tests", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def values(spark):
    """Evaluate a column over one list of inputs: values(column_of_x, [..])."""

    def run(make, inputs, kind="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        from pyspark.sql import functions as F

        rows = df.select("i", make(F.col("x")).alias("y")).collect()
        return [r.y for r in sorted(rows, key=lambda r: r.i)]

    return run
