from __future__ import annotations

import pytest

from circula.llm.tables import Staging, importable


@pytest.fixture
def stage(spark):
    importable(spark)
    return Staging(spark, "test")


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)
