import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


#: Tests of some ten seconds and more: `pytest -m "not slow"` leaves them out.
SLOW = ("tests/llm/", "test_whole_", "test_best_split", "test_models", "test_split_from_urls", "test_bootstrap_of_rows", "model_", "c_selection", "bootstrap", "frozen_", "feature_shift", "image_features", "split_candidates", "best_split", "dataset_validation")


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: takes some ten seconds or more")


def pytest_collection_modifyitems(items):
    for item in items:
        if any(s in item.nodeid for s in SLOW):
            item.add_marker(pytest.mark.slow)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
