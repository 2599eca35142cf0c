"""Structured Streaming form of the intake: running marks of a stream on two clocks, and a late flag on every row. Late rows are flagged, never dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream long, seq long, episode timestamp, arrival_mark long, episode_mark timestamp, late boolean"
STATE = "arrival long, episode timestamp"


def _marks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a stream come in order of ``seq`` inside a micro-batch; the marks so far are the state."""
    arrival, episode = state.get if state.exists else (None, None)
    episode = pd.Timestamp(episode) if episode is not None else None
    f = pd.concat(list(frames)).sort_values("seq")
    rows = []
    for seq, at in zip(f.seq, f.episode, strict=True):
        known = not pd.isna(at)
        late = known and episode is not None and at < episode
        arrival = seq if arrival is None else max(arrival, seq)
        if known:
            episode = at if episode is None else max(episode, at)
        rows.append((key[0], seq, at, arrival, episode, late))
    state.update((int(arrival), episode.to_pydatetime() if episode is not None else None))
    yield pd.DataFrame(rows, columns=["stream", "seq", "episode", "arrival_mark", "episode_mark", "late"])


def marks(events: DataFrame) -> DataFrame:
    """``events(stream, seq, episode)``, a streaming frame, with its marks and flags."""
    return events.select("stream", "seq", "episode").groupBy("stream").applyInPandasWithState(_marks, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
