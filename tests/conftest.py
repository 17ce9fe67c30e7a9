import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger rows (day, account, type, name, memo, amount) as the loader would give them."""

    def make(rows):
        columns = "day string, account string, account_type string, name string, memo string, amount double"
        return spark.createDataFrame(rows, columns).selectExpr(
            "cast(day as timestamp_ntz) as date", "account", "account_type", "name", "memo", "amount"
        )

    return make


@pytest.fixture
def one():
    """The single row of a result as a dict."""

    def fetch(df):
        (row,) = df.collect()
        return row.asDict()

    return fetch
