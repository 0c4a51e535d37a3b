"""Streaming forms of the incremental behaviours: version watch, baselines and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import EXTREME, MAD_SHARE, MIN_HISTORY, UNUSUAL


def version_watch(scans: DataFrame) -> DataFrame:
    """State of each scan (source, seq, fingerprint, files, locked) against the last captured one.

    EMPTY, LOCKED and UNCHANGED scans leave the captured fingerprint as it is; a scan that is not
    newer than the last one is OUT_OF_ORDER, which asks for that source to be rebuilt.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seq = state.get if state.exists else (None, -1)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.seq <= seq:
                what = "OUT_OF_ORDER"
            elif not row.files:
                what = "EMPTY"
            elif row.locked:
                what = "LOCKED"
            elif row.fingerprint == last:
                what = "UNCHANGED"
            else:
                what, last = "NEW_VERSION", row.fingerprint
            seq = max(seq, row.seq)
            out.append((key[0], row.seq, what))
        state.update((last, seq))
        yield pd.DataFrame(out, columns=["source", "seq", "state"])

    return scans.groupBy("source").applyInPandasWithState(step, "source string, seq long, state string", "last string, seq long", "append", GroupStateTimeout.NoTimeout)


def baseline_watch(values: DataFrame) -> DataFrame:
    """Class of each value (series, seq, value) against all earlier ones of its series.

    Gives what the batch window gives when values come in order. The state is a series' history,
    which a product's number of versions bounds.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            out.append((key[0], row.seq, len(history), classified(row.value, history)))
            if row.value is not None and row.value == row.value:
                history.append(float(row.value))
        state.update((history,))
        yield pd.DataFrame(out, columns=["series", "seq", "n_history", "class"])

    return values.groupBy("series").applyInPandasWithState(step, "series string, seq long, n_history int, class string", "history array<double>", "append", GroupStateTimeout.NoTimeout)


def classified(value: float | None, history: list[float]) -> str:
    import statistics

    if value is None or value != value or len(history) < MIN_HISTORY:
        return "UNKNOWN"
    median = statistics.median(history)
    mad = statistics.median(abs(x - median) for x in history)
    if mad == 0:
        return "NORMAL" if value == median else "EXTREME"
    z = MAD_SHARE * abs(value - median) / mad
    return "EXTREME" if z >= EXTREME else "UNUSUAL" if z >= UNUSUAL else "NORMAL"


def event_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per window and type; what comes later than the watermark allows is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of a user, closed when the watermark passes their gap."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return own.select("user_id", F.col("s.start").alias("start"), "n")
