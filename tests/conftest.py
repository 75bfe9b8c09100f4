import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lanternmill.session import session

    scratch = tmp_path_factory.mktemp("shared")
    out = session(
        "local[4]",
        **{
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(scratch / "warehouse"),
            "spark.checkpoint.dir": f"file://{scratch}/checkpoints",
        },
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
