import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from listwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "listwright-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column builder to literal values: apply(build, [(a, b), ...], "a string, b int")."""

    def run(build, rows, schema):
        numbered = [(i, *row) for i, row in enumerate(rows)]
        frame = spark.createDataFrame(numbered, f"_i int, {schema}")
        names = frame.columns[1:]
        result = frame.select("_i", build(*(frame[n] for n in names)).alias("_out"))
        return [row["_out"] for row in result.orderBy("_i").collect()]

    return run
