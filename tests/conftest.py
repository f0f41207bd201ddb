import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from noctua.session import build_session

    with tempfile.TemporaryDirectory(prefix="spark-") as scratch:
        session = build_session(
            "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.local.dir": scratch, "spark.checkpoint.dir": f"{scratch}/shared", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{scratch}/warehouse"}
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
