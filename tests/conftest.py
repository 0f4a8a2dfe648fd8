import os
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


T0 = datetime(2025, 3, 10, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def log_rows(spark):
    """Log rows of lines, or of (line, labels) or (line, labels, seconds)."""
    from tidelog.model import SCHEMA

    def make(items, step=1.0):
        rows = []
        for i, x in enumerate(items):
            line, labels, at = (x, {}, i * step) if isinstance(x, str) or x is None else (*x, i * step)[:3] if len(x) == 2 else x
            rows.append((i, T0 + timedelta(seconds=at), labels, line, None))
        return spark.createDataFrame(rows, SCHEMA)

    return make
