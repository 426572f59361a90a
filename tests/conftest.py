import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(4, "tests")


def hours(n, start=datetime(2024, 1, 1)):
    return [start + timedelta(hours=i) for i in range(n)]


BARS = (
    "venue string, instrument_id string, bar_type string, timestamp timestamp_ntz, open double, "
    "high double, low double, close double, volume double, volume_ccy double, volume_quote double, "
    "confirm int"
)


def candles(spark, closes, *, quote=None, minutes=60, high=None, low=None, open_=None, name="A"):
    """Bars with the given closes on a gapless grid."""
    rows = []
    for i, c in enumerate(closes):
        at = datetime(2024, 1, 1) + timedelta(minutes=minutes * i)
        rows.append(
            (
                "X", name, "1h" if minutes == 60 else "1m", at,
                float(c - 0.5 if open_ is None else open_),
                float(c + 1 if high is None else high),
                float(c - 1 if low is None else low),
                float(c), 10.0 + i, 20.0 + i,
                float(1000 + 100 * i if quote is None else quote[i]), 1,
            )
        )
    return spark.createDataFrame(rows, BARS)
