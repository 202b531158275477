import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("factloom.shared.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("OFF")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
