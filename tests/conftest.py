from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("postloom-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def spark():
    return session()
