"""One session for all tests; the tables of the driver where they are there."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("QUERN_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern import session

    shared = tmp_path_factory.mktemp("shared")
    found = session(
        "tests",
        os.environ.get("QUERN_TEST_MASTER", "local[4]"),
        spark_sql_shuffle_partitions=4,
        spark_ui_enabled=False,
        spark_driver_memory="4g",
        **{"spark_checkpoint_dir": str(shared), "spark_sql_warehouse_dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).is_dir():
        pytest.skip(f"no tables in {DATA}")
    return DATA
