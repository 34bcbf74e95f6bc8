"""Duplicate cases in a stream: the registry as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_duplicates(cases: DataFrame, key: str = "signature") -> DataFrame:
    """cases (case_ord, and a key) of a stream as case_ord, key, duplicate_of: the first case with its key, or null for that case itself.

    The state of a key is its first case.  Cases of one batch count in their
    order; a case that comes in a later batch than one with a higher order is
    still a duplicate of what was there first.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("case_ord")
        of = []
        for c in rows["case_ord"]:
            of.append(first)
            first = c if first is None else first
        state.update((int(first),))
        yield pd.DataFrame({"case_ord": rows["case_ord"], "key": name[0], "duplicate_of": pd.array(of, dtype="Int64")})

    keyed = cases.select("case_ord", F.lower(F.col(key)).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("key").applyInPandasWithState(run, "case_ord long, key string, duplicate_of long", "first long", "append", GroupStateTimeout.NoTimeout)


def stream_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a job log (ts, event_type) in windows; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
