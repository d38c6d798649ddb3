import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from minutewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, name="tests")


def at(text):
    """'HH:MM[:SS]' on 2026-01-01, UTC."""
    parts = [int(p) for p in text.split(":")] + [0]
    return datetime(2026, 1, 1, parts[0], parts[1], parts[2], tzinfo=timezone.utc)


def minute(n):
    return datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=n)


def utc_text(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows]
