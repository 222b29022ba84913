import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from ribospan.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session(4, shuffle_partitions=4, **{"spark.checkpoint.dir": str(shared)})
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate one Column over an optional single row."""
    def run(column, **row):
        df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
        return df.select(column.alias("v")).collect()[0]["v"]

    return run
