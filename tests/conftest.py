import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logloom.session import build_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.log.level": "ERROR", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture()
def log_rows(spark):
    """Log rows from (session, role, content) in order, one minute apart."""
    def make(*rows):
        return spark.createDataFrame(
            [(i, s, f"2024-01-01T00:{i:02d}:00.000000+00:00", role, content)
             for i, (s, role, content) in enumerate(rows)],
            "id bigint, session_id string, timestamp string, role string, content string")

    return make
