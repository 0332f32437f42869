import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gradelake.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse", "spark.sql.shuffle.partitions": "4"}
    session = get_session("tests", **conf)
    yield session
    session.stop()
