import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from panelloom.session import get_spark

    session = get_spark(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def panel(spark):
    """Build a panel from ``{series: [(date, value), ...]}`` in arrival order."""
    import datetime as dt

    def build(series):
        rows = []
        for name, points in series.items():
            for seq, (date, value) in enumerate(points):
                day = dt.date.fromisoformat(date) if date else None
                rows.append((name, day, None if value is None else float(value), seq))
        return spark.createDataFrame(rows, "series_id string, date date, value double, ingest_seq bigint")

    return build


def days(start, count, step=1):
    import datetime as dt

    first = dt.date.fromisoformat(start)
    return [(first + dt.timedelta(days=i * step)).isoformat() for i in range(count)]
