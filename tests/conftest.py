import os
import sys
import tempfile
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_by_default() -> bool:
    """Whether sessions here name a shared folder of their own accord."""
    return any("spark.checkpoint.dir" in f.read_text() for f in Path(pyspark.__file__).parent.glob("conf/spark-defaults.conf"))


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
    )
    if not shared_by_default():
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tierlens-tests-"))
    session = builder.getOrCreate()
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])
