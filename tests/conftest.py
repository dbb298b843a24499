from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", master="local[4]", shuffle_partitions=4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"
