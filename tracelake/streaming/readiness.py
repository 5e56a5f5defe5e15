"""Observations as streams: sightings without repeats, and the moment at which a page is ready."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.operators.sequences import stable_runs

RESULT = "state_id string, status string, reason string, timeout_reason string, polls long, elapsed_ms long"
HELD = "started long, signature string, run long, polls long, evidence long, loaders long, last long, done boolean"


def first_sightings(observations: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Each observation once, repeats of its keys that come within `late` left out; the state is bounded by the watermark."""
    return observations.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def readiness_states(polls: DataFrame, timeout_ms: int = 10_000, stable: int = 2, late: str = "10 minutes") -> DataFrame:
    """polls (state_id, polled_at, signature, evidence, loaders) as a stream -> one row for each state (RESULT): ready at the
    first poll at which evidence is there, nothing loads, and `stable` polls in a row were equal; or partial with a reason, once
    the watermark has passed its first poll by timeout_ms without that. Polls after the timeout count for nothing. A state keeps
    one row, and goes with the timer of its timeout."""

    class Polls(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", HELD)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("ms")  # the polls of one state in one batch
            held, found = self.held.get(), None
            if held is None:
                started = int(batch["ms"].iloc[0])
                held = (started, None, 0, 0, 0, 0, started, False)
                self.handle.registerTimer(started + timeout_ms)
            started, signature, run, polls, evidence, loaders, last, done = held
            for r in batch.itertuples():
                at = int(r.ms)
                if done or at - started >= timeout_ms:
                    continue
                run = run + 1 if r.signature == signature else 1
                signature, polls, evidence, loaders, last = r.signature, polls + 1, int(r.evidence), int(r.loaders), at
                if evidence > 0 and loaders == 0 and run >= stable:
                    done, found = True, (key[0], "ready", "semantic-ui", None, polls, at - started)
            self.held.update((started, signature, run, polls, evidence, loaders, last, done))
            if found:
                yield _told(found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            started, _, _, polls, evidence, loaders, last, done = self.held.get()
            self.held.clear()
            if not done:
                why = "visible-loading-state" if loaders else "no-substantive-destination-content" if not evidence else "unstable-destination-content"
                yield _told((key[0], "partial", "semantic-timeout", why, polls, last - started))

        def close(self) -> None:
            pass

    at = F.col("polled_at").cast("timestamp")
    marked = polls.withColumn("polled_at", at).withColumn("ms", F.unix_millis("polled_at")).withWatermark("polled_at", late)
    return marked.groupBy("state_id").transformWithStateInPandas(statefulProcessor=Polls(), outputStructType=RESULT, outputMode="append", timeMode="EventTime")


def _told(row: tuple) -> pd.DataFrame:
    return pd.DataFrame([row], columns=["state_id", "status", "reason", "timeout_reason", "polls", "elapsed_ms"])


def readiness_table(polls: DataFrame, timeout_ms: int = 10_000, stable: int = 2) -> DataFrame:
    """The same over a table, in which every state has come to its end."""
    by_state = W.partitionBy("state_id")
    at = F.unix_millis(F.col("polled_at").cast("timestamp"))
    rows = polls.withColumn("__since", at - F.min(at).over(by_state)).filter(F.col("__since") < timeout_ms)
    runs = stable_runs(rows, "state_id", ["polled_at"], "signature").withColumn("__n", F.row_number().over(by_state.orderBy("polled_at")).cast("long"))
    ready = (F.col("evidence") > 0) & (F.col("loaders") == 0) & (F.col("stable_polls") >= stable)
    told = F.struct("__n", "__since", "evidence", "loaders")
    found = runs.groupBy("state_id").agg(F.min(F.when(ready, told)).alias("hit"), F.max(told).alias("last"))
    why = F.when(F.col("last.loaders") != 0, F.lit("visible-loading-state")).when(F.col("last.evidence") == 0, F.lit("no-substantive-destination-content")).otherwise(F.lit("unstable-destination-content"))
    good, end = F.col("hit").isNotNull(), F.coalesce("hit", "last")
    return found.select(
        "state_id", F.when(good, F.lit("ready")).otherwise(F.lit("partial")).alias("status"), F.when(good, F.lit("semantic-ui")).otherwise(F.lit("semantic-timeout")).alias("reason"),
        F.when(~good, why).alias("timeout_reason"), end["__n"].alias("polls"), end["__since"].alias("elapsed_ms"),
    )
