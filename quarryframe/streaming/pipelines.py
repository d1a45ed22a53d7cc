"""Streams of manifests and events: idempotent events, reconciled snapshots, debounced bursts and per-repository queues.

Event time, watermarks and late data follow Spark's own rules; rows without a key or time are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, event_id: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.where(F.col(event_id).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])


def bursts(events: DataFrame, key: str, time: str, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, window, events): events of a key that are less than `quiet` apart, as session windows."""
    return events.where(F.col(key).isNotNull()).withWatermark(time, late).groupBy(F.session_window(time, quiet).alias("window"), key).agg(F.count("*").alias("events"))


def changes_per_batch(write: Callable[[DataFrame, int], None], state: Callable[[], DataFrame | None], keep: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: manifests (repo_id, path, sha256) against the state before, as created, modified, deleted or renamed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = batch.select("repo_id", "path", "sha256").distinct()
        before = state()
        if before is None:
            write(now.select("repo_id", "path", F.lit("startup").alias("reason")), batch_id)
        else:
            seen = now.select("repo_id").distinct()  # only repositories in this batch are reconciled
            old = before.join(seen, "repo_id", "left_semi").select("repo_id", "path", F.col("sha256").alias("was"))
            j = old.join(now, ["repo_id", "path"], "full")
            made, gone = j.where("was is null"), j.where("sha256 is null")
            # of the paths of a hash the first that is gone pairs with the first that is new, the second with the second
            nth = F.row_number().over(Window.partitionBy("repo_id", "h").orderBy("path")).alias("n")
            new_ = made.select("repo_id", F.col("sha256").alias("h"), "path").select("repo_id", "h", F.col("path").alias("to"), nth)
            pairs = new_.join(gone.select("repo_id", F.col("was").alias("h"), "path").select("repo_id", "h", "path", nth), ["repo_id", "h", "n"])
            moved = pairs.select("repo_id", "path", "to")
            rest = j.where("was is null or sha256 is null or was <> sha256").join(moved.select("repo_id", "path"), ["repo_id", "path"], "left_anti").join(moved.select("repo_id", F.col("to").alias("path")), ["repo_id", "path"], "left_anti")
            reason = F.when(F.col("was").isNull(), "create").when(F.col("sha256").isNull(), "delete").otherwise("modify")
            write(rest.select("repo_id", "path", reason.alias("reason")).unionByName(moved.select("repo_id", F.col("to").alias("path"), F.lit("rename").alias("reason"))), batch_id)
        keep(now)

    return run


_QUEUE = "repo_id string, state string, runs long, follow_up boolean"


def queue_states(events: DataFrame) -> DataFrame:
    """(repo_id, state, runs, follow_up): a queue per repository; a request while one runs is told as one follow-up, however many come."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        running, runs, follow = state.get if state.exists else (False, 0, False)
        for f in frames:
            for kind in f.sort_values("at")["kind"]:
                if kind == "request":
                    running, runs, follow = (True, runs, True) if running else (True, runs + 1, False)
                elif kind == "done":
                    running, runs, follow = (follow, runs + int(follow), False)
        state.update((running, runs, follow))
        yield pd.DataFrame([(key[0], "running" if running else "idle", runs, follow)], columns=["repo_id", "state", "runs", "follow_up"])

    rows = events.where("repo_id is not null and kind is not null").select("repo_id", "kind", "at")
    return rows.groupBy("repo_id").applyInPandasWithState(step, _QUEUE, "running boolean, runs long, follow boolean", "update", GroupStateTimeout.NoTimeout)
