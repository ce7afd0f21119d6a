from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from skyquarry.engine.session import ship

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    folder = tmp_path_factory.mktemp("spark")
    own = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(folder / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    own.sparkContext.setLogLevel("ERROR")
    yield ship(own)
    own.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.001")
