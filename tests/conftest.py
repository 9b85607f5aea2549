import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemill.session import build_session, work_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return work_dir(spark, "test")


@pytest.fixture
def documents(spark):
    rows = [
        ("BIS_2024_001", "2024-01-15", "FED", "Powell", "Policy", "a" * 200, True),
        ("BIS_2024_002", "2024-02-20", "ECB", "Lagarde", "Outlook", "b" * 200, False),
        ("ECB_2024_001", "2024-03-10", "ECB", "Lane", "Trade", "c" * 200, True),
    ]
    return spark.createDataFrame(
        rows,
        "reference string, date string, central_bank string, speaker string, title string, "
        "text string, is_gov boolean",
    )


@pytest.fixture
def labels(spark):
    rows = [
        ("BIS_2024_001", 3, 3, 0, 3, "success", "", 1, False),
        ("BIS_2024_002", 4, 2, 1, 4, "success", "", 2, False),
        ("ECB_2024_001", 3, 3, 0, 2, "failed", "timeout", 5, True),
    ]
    return spark.createDataFrame(
        rows,
        "reference string, monetary_stance int, trade_stance int, tariff_mention int, "
        "economic_outlook int, _llm_status string, _llm_error string, _llm_attempts bigint, "
        "_llm_fallback_used boolean",
    )
