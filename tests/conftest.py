from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")
    from engramic.session import session

    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
