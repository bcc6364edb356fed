import datetime as dt

import pytest
from pyspark.sql import SparkSession

from stintworks.schemas import STAGING


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_stints(spark):
    """Staging rows from dicts; unnamed columns are NULL, counts default to what the case needs."""
    def make(*rows, identity=False):
        filled = []
        for number, row in enumerate(rows, start=1):
            base = {"batch_id": 1, "source_row_number": number, "id": number, "season": 2025, "season_label": "2025/26",
                    "player_name": "P", "source_player_key": "p", "squad_name": "A", "competition_name": "L",
                    "position_raw": "FW", "imported_at": dt.datetime(2026, 1, 1)}
            base.update(row)
            filled.append(tuple(base.get(f.name) for f in STAGING.fields))
        frame = spark.createDataFrame(filled, STAGING)
        if identity:
            frame = frame.selectExpr("*", "source_player_key AS canonical_player_key", "player_name AS canonical_player_name")
        return frame

    return make
