import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session
    s = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
