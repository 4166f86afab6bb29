"""The challenge as a stream: one state for each change request, with a timer for the 72 hours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.federation import LEAST_WORDS, TIMEOUT_SECS

OUT = "repo string, number long, state string, at long"


class Challenge(StatefulProcessor):
    """Rows (repo, number, kind, author, body, secs): kind 'posted' opens a challenge (body is its canary), 'reply' answers it.

    A settled challenge stays as it is.  Only the author that the challenge names can
    answer.  The time runs by the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("challenge", "state string, canary string, author string, posted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("secs", kind="stable").itertuples():
            if row.kind == "posted":
                if now is None:
                    now = ("pending", row.body, row.author, int(row.secs))
                    self.handle.registerTimer((int(row.secs) + TIMEOUT_SECS) * 1000)
                    out.append((*key, "pending", int(row.secs)))
            elif now is not None and now[0] == "pending" and row.author == now[2]:
                state = "failed_timeout" if row.secs >= now[3] + TIMEOUT_SECS else "failed_canary" if now[1] in row.body else "passed" if len(row.body.split()) >= LEAST_WORDS else "pending"
                if state != "pending":
                    now = (state, *now[1:])
                    out.append((*key, state, int(row.secs)))
        if now is not None:
            self.state.update(tuple(now))
        yield pd.DataFrame(out, columns=["repo", "number", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        out = []
        if now is not None and now[0] == "pending":
            self.state.update(("failed_timeout", *now[1:]))
            out.append((*key, "failed_timeout", now[3] + TIMEOUT_SECS))
        yield pd.DataFrame(out, columns=["repo", "number", "state", "at"])

    def close(self) -> None:
        pass


def challenges(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The changes of state of a stream of (repo, number, kind, author, body, secs, ts)."""
    return events.withWatermark("ts", delay).groupBy("repo", "number").transformWithStateInPandas(Challenge(), OUT, "append", "EventTime")
