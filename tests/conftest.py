import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from estatelens.schemas import FILES, PROJECTS  # noqa: E402
from estatelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "estatelens-tests", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files of project 1 from path to text."""

    def build(texts: dict[str, str], project_id: int = 1):
        rows = [(project_id, "sha", path, text) for path, text in texts.items()]
        return spark.createDataFrame(rows, FILES)

    return build


@pytest.fixture(scope="session")
def make_projects(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), PROJECTS)

    return build


@pytest.fixture(scope="session")
def rows_of():
    """Selected columns as plain tuples, in ``seq`` order where there is one."""

    def collect(df, *cols):
        if "seq" in df.columns:
            df = df.orderBy("seq")
        return [tuple(r) for r in df.select(*cols).collect()]

    return collect
