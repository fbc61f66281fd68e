"""Recovery rounds as a stream: each segment's best candidate so far is its state, and runs that stall are cancelled by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KEPT = "segment_id string, round long, text string, rank array<double>, again boolean"
RUNS = "request_id string, status string, at timestamp, ended_by string"


def kept(candidates: DataFrame) -> DataFrame:
    """The candidate that each segment keeps after a micro-batch, for those that changed. candidates: segment_id, round, text, rank (array<double>), again.

    The fold of ``recovery.recovered``: only a better one replaces, and only while the one before would be asked for again. A segment's rounds
    come in order; what a micro-batch holds of it is sorted. State is one row a segment.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows = rows.assign(order=[tuple(r) for r in rows["rank"]]).sort_values(["round", "order"], ascending=[True, False], kind="stable")
        now = tuple(state.get) if state.exists else None
        changed = False
        for r in rows.itertuples(index=False):
            if now is None or (now[3] and r.order > tuple(now[2])):
                now, changed = (int(r.round), r.text, [float(x) for x in r.order], bool(r.again)), True
        if changed:
            state.update(now)
            yield pd.DataFrame({"segment_id": [key[0]], "round": [now[0]], "text": [now[1]], "rank": [now[2]], "again": [now[3]]})

    return candidates.groupBy("segment_id").applyInPandasWithState(fold, KEPT, "round long, text string, rank array<double>, again boolean", "update", "NoTimeout")


def ended(events: DataFrame, silent: str = "15 minutes", late: str = "5 minutes") -> DataFrame:
    """How each run ended: by its own last event, or cancelled when event time has passed its last sign by ``silent``. events: request_id, ts, status.

    running and queued keep a run open and set its timer again; any other status ends it. What comes for a run that has ended begins it anew.
    """
    wait = int(pd.Timedelta(silent).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "status": ["cancelled"], "at": [pd.Timestamp(at, unit="us")], "ended_by": ["timer"]})
            return
        out = []
        at = state.get[0] if state.exists else None
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples(index=False):
            if r.status in ("running", "queued"):
                at = max(at or 0, r.ts.value // 1000)
            else:
                at = None
                out.append((key[0], r.status, r.ts, "event"))
        if at is None:
            if state.exists:
                state.remove()
        else:
            state.update((at,))
            state.setTimeoutTimestamp(max(at // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "status", "at", "ended_by"])

    return events.withWatermark("ts", late).groupBy("request_id").applyInPandasWithState(follow, RUNS, "at long", "append", "EventTimeTimeout")
