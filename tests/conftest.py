import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quernstone.session import build

    os.environ.setdefault("PYTHONPATH", sys.path[0])
    session = build("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
