import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerflow.session import session

    top = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.driver.memory": "3g",
        "spark.checkpoint.dir": f"file://{top}/shared", "spark.driver.extraJavaOptions": f"-Dderby.system.home={top}",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
