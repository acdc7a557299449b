import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillmesh.session import build_session

    s = build_session("tests", 4, 4, {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})
    yield s
    s.stop()
