import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditlake.session import local_session  # noqa: E402
from auditlake.sources.files import path_attributes  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def files_of(spark):
    """Files table from (path, content) or (workspace, path, content) rows."""
    def build(*rows):
        full = [r if len(r) == 3 else ("ws", *r) for r in rows]
        return path_attributes(spark.createDataFrame(full, "workspace STRING, path STRING, content STRING"))
    return build
