import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lineloom.session import session

    s = session(
        "local[4]", "tests",
        **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_checkpoint_dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark_sql_warehouse_dir": f"file://{tmp_path_factory.mktemp('warehouse')}"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
