import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from playerlytics.session import local_session
    s = local_session(4, 4, app="playerlytics-tests")
    yield s
    s.stop()


def event(user="u1", game="GAME_A", ts=0, tz="+00:00", **kw):
    """One raw game event as a dict with every EVENT_SCHEMA field."""
    from playerlytics.sources.schemas import EVENT_SCHEMA
    row = {f.name: None for f in EVENT_SCHEMA.fields}
    row.update(userId=user, gameId=game, timestamp=ts, timezone=tz, **kw)
    return row


def events_df(spark, rows):
    from playerlytics.sources.schemas import EVENT_SCHEMA
    return spark.createDataFrame([tuple(r[f.name] for f in EVENT_SCHEMA.fields) for r in rows], EVENT_SCHEMA)


def ms(text):
    """'2024-01-05 23:30:00' (UTC) -> epoch ms."""
    from datetime import datetime, timezone
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)
