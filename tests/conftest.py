import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from trawlspark.session import session

    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="trawl-tests-"), "spark.default.parallelism": "4",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="trawl-warehouse-"),
    }
    spark = session("local[8]", "tests", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=str)
