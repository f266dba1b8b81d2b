import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from memq import session

    s = session.build(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true"},
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    session.release()
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test tables here")
    return str(d)
