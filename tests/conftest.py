import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from (user, minutes after T0, type[, properties[, platform]]) tuples."""

    def make(rows):
        data = []
        for i, r in enumerate(rows):
            user, minute, kind, props, platform = (*r, None, None)[:5] if len(r) < 5 else r
            data.append((user, T0 + dt.timedelta(minutes=minute), kind, i, platform or "ios", props))
        return spark.createDataFrame(
            data, "user_id long, event_time timestamp, event_type string, event_id long, platform string, event_properties string"
        )

    return make
