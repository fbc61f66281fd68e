"""Streams of requests: admission under a sliding limit, merged request state, windowed usage."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADMITTED = "profile string, request_id long, ts timestamp, tokens long, admitted boolean, waiting_us long"
STATE = "at array<long>, tokens array<long>"


def admitted(events: DataFrame, requests: int, tokens: int, seconds: int = 60) -> DataFrame:
    """For each request of (profile, request_id, ts, tokens): whether it was admitted when it came, and how long it would have to wait.

    A request is admitted while the profile's requests and tokens of the last ``seconds`` stay under both limits; one whose tokens
    alone exceed the limit is admitted when no other is in the window. State is the window's admitted requests only.
    """
    width = seconds * 1_000_000

    def replay(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, used = ([deque(x) for x in state.get] if state.exists else (deque(), deque()))
        held = sum(used)
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"], ignore_index=True)
        out = []
        for ts, n in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["tokens"].fillna(0).astype("int64"), strict=True):
            while at and at[0] <= ts - width:
                at.popleft()
                held -= used.popleft()
            ok = not at or (len(at) < requests and held + n <= tokens)
            wait = 0
            if not ok:
                left, count, last = held, len(at), None
                for last, freed in zip(at, used, strict=True):
                    left, count = left - freed, count - 1
                    if count < requests and left + n <= tokens:
                        break
                wait = last + width - ts
            else:
                at.append(int(ts))
                used.append(int(n))
                held += int(n)
            out.append((ok, int(wait)))
        state.update((list(at), list(used)))
        rows["profile"] = key[0]
        rows["admitted"], rows["waiting_us"] = [x[0] for x in out], [x[1] for x in out]
        yield rows[["profile", "request_id", "ts", "tokens", "admitted", "waiting_us"]]

    return events.groupBy("profile").applyInPandasWithState(replay, ADMITTED, STATE, "append", "NoTimeout")


def usage(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and tokens by profile and window, for events with a watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every), "profile").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    return rows.select("profile", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests", "tokens")


def once(events: DataFrame, key: str = "request_id", late: str = "10 minutes") -> DataFrame:
    """Events without those delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stalls(heartbeats: DataFrame, gap: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of heartbeats: a gap ends one."""
    rows = heartbeats.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "profile").agg(F.count(F.lit(1)).alias("beats"))
    return rows.select("profile", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "beats")
