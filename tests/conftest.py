import tempfile

import pytest


@pytest.fixture(scope="session")
def spark():
    from flowgrid.session import get_session

    session = get_session(
        "tests", master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ckpt-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="wh-")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
