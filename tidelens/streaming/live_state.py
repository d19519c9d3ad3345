"""Live session features with a state store: each micro-batch touches only the users that occur in it.

The state of a user is four numbers (session start, last event, events, bit set of event types), kept by Spark's state store; a timer drops
it once the watermark has passed the session gap.  Rows count as late against the watermark of the micro-batch before, as in Spark's other
stateful operators.  A user's rows of one micro-batch meet in one call, as arrays; where a single user may fill a
micro-batch, ``streams.live_session_features`` spreads its rows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelens.functions.columns import US_PER_MINUTE
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

#: The state store that processors with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenSessions(StatefulProcessor):
    """Running features of each event in its session, from the open session of the user on."""

    def __init__(self, gap_us: int, names: list[str]):
        self.gap_us, self.names = gap_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, n long, mask long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        us, bits = t["us"].to_numpy(np.int64), t["bit"].to_numpy(np.int64)
        state = self.open.get() if self.open.exists() else None
        latest = np.maximum.accumulate(np.r_[state[1], us] if state else us)
        before = latest[:-1]
        opens = us - before > self.gap_us if state else np.r_[True, us[1:] - before > self.gap_us]
        group = np.cumsum(opens)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        of = np.searchsorted(first, np.arange(len(us)), "right") - 1
        start, n = us[first][of], np.arange(len(us)) - first[of] + 1
        mask = bits.copy()
        for i, j in zip(first, np.r_[first[1:], len(us)], strict=True):  # sessions, not rows
            mask[i:j] = np.bitwise_or.accumulate(bits[i:j])
        if state and not opens[0]:  # the first stretch goes on with the open session
            going = of == 0
            start[going], n[going], mask[going] = state[0], n[going] + state[2], mask[going] | state[3]
        until = latest[1:] if state else latest
        self.open.update((int(start[-1]), int(until[-1]), int(n[-1]), int(mask[-1])))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(int(until[-1] + self.gap_us) // 1000 + 1)
        has = {name: (mask >> i & 1).astype(np.int32) for i, name in enumerate(self.names)}
        counted = np.array([int(m).bit_count() for m in np.unique(mask)], np.int64)[np.unique(mask, return_inverse=True)[1]]
        minutes = np.minimum((until - start) / US_PER_MINUTE, 120.0)
        out = {"user_id": key[0], "session_start_us": start, "event_us": us, "events_in_session": n, "unique_events": counted, "session_duration_mins": np.maximum(minutes, 0.0), **has}
        depth = sum(has[name] for name in self.names[:4])
        yield pd.DataFrame(out | {"funnel_depth": depth})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_session_features(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, gap_minutes: float = 30, watermark: str = "1 hour"
) -> DataFrame:
    """The features of ``streams.live_session_features`` as a streaming frame, kept by a state processor.

    The session's state store is set to one that supports processors; it holds for streams started from now on.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seen = (vocab.homepage, vocab.product_view, vocab.add, vocab.checkout_button, vocab.order)
    bit = F.lit(1 << 62)
    for i, t in enumerate(dict.fromkeys((*seen, *vocab.event_types))):
        bit = F.when(F.col("event_type") == t, F.lit(1 << i).cast("long")).otherwise(bit)
    names = [f"has_{t}" for t in seen]
    schema = f"user_id long, session_start_us long, event_us long, events_in_session long, unique_events long, session_duration_mins double, {', '.join(f'`{n}` int' for n in names)}, funnel_depth int"
    rows = events.withWatermark("event_time", watermark).select("user_id", "event_time", F.unix_micros("event_time").alias("us"), "event_id", bit.alias("bit"))
    return rows.groupBy("user_id").transformWithStateInPandas(OpenSessions(int(gap_minutes * US_PER_MINUTE), names), schema, "Append", "EventTime")
