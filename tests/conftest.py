from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session("4", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    """Sorted rows as plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
