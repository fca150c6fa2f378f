"""Goals and dismissals out of events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.shots import key_event_columns
from touchline.streaming.unseen import append_unseen

KEY = ["match_id", "event_id"]


def key_event_stream(events: DataFrame) -> DataFrame:
    """The batch filter on a stream.  It holds no state and drops nothing for being late."""
    return key_event_columns(events).select(
        "match_id", "event_id", "index", "event_type", "player", "team", "minute", "xg",
    )


def store_key_events(events: DataFrame, path: str, name: str, **options) -> StreamingQuery:
    """Append each key event to the table once, in whatever order and however late it comes.

    An event that was delivered before is known by its id in the state of the
    stream, so there is no span of time after which a repeat or a late goal is
    lost, and the stored table is not read for it.
    """
    return append_unseen(key_event_stream(events), path, KEY, name, **options)
