from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():  # noqa: ANN201
    from webloom.session import get_session

    return get_session("tests", "local[4]", 4)
