import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sojourn.schema import EVENT  # noqa: E402
from sojourn.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Builder: rows of ``subject, time, code[, value, visit, type]`` to an event frame."""

    def build(*rows):
        full = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
        return spark.createDataFrame(full, EVENT)

    return build


@pytest.fixture
def texts(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "subject_id bigint, text string")

    return build
