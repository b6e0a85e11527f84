import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.runtime import build_session  # noqa: E402

BASE_US = 1_767_225_600_000_000  # 2026-01-01T00:00:00Z


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def topic_vector():
    """A unit vector per integer key: equal keys are one topic, different keys are far apart."""

    def make(key: int, dim: int = 32) -> np.ndarray:
        v = np.random.default_rng(1000 + key).normal(size=dim).astype(np.float32)
        return v / np.linalg.norm(v)

    return make
