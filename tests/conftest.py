from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lustra.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "lustra-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def each(spark):
    """Apply an expression over ``x`` to a list of texts."""

    def run(expression: str, values: list, kind: str = "string") -> list:
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, x {kind}").selectExpr("i", f"{expression} AS y")
        return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return run
