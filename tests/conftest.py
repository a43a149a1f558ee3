import datetime as dt
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    from chargeload.config import get_spark

    s = get_spark("chargeload-tests", cpus="*", shuffle_partitions=8)
    yield s
    s.stop()


def utc(*a) -> dt.datetime:
    return dt.datetime(*a, tzinfo=UTC)


def naive(ts):
    """Spark returns naive datetimes in the session zone (UTC)."""
    if ts is None:
        return None
    return ts.replace(tzinfo=None) if ts.tzinfo else ts
