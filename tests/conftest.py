import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lettermill.session import drop_work, local_session  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_work(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture
def mini_emails(spark):
    rows = [
        (f"id{i}", f"email{i}", f"subject{i}", [f"thread{i}"], "2024-01-01T10:00:00", None)
        for i in range(3)
    ]
    return spark.createDataFrame(
        rows,
        "email_id string, email string, subject string, thread array<string>, "
        "date_iso string, summary string",
    )
