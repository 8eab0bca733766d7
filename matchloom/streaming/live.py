"""Structured Streaming forms: windows, cumulative counters, keyed state, interval joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.session import checkpoint_dir


def source(spark, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """File stream; back-pressure is the files-per-trigger limit, nothing is dropped."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def counts_in_window(events: DataFrame, length: str, slide: str | None, *by: str, late: str = "60 days") -> DataFrame:
    """Counts per sliding or tumbling event-time window."""
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    d = events.withWatermark("ts", late).groupBy(win.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, late: str = "60 days") -> DataFrame:
    d = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def unique_events(events: DataFrame, key: str, late: str = "60 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def live_stats(events: DataFrame) -> DataFrame:
    """Cumulative counters per match and team, pushed in update mode."""
    kind = F.col("event_type")
    return events.groupBy("match_id", "team").agg(
        *[F.sum((kind == k).cast("bigint")).alias(f"{k}s") for k in ("goal", "shot", "save", "pass")])


def debounce(events: DataFrame, keys: list[str], cooldown: int, schema: str) -> DataFrame:
    """At most one row per key within ``cooldown`` frames of the last one passed on; state is one number."""
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frames = sorted(set(f for p in pdfs for f in p.frame_n.tolist()))
        out = []
        for f in frames:
            if last is None or f - last >= cooldown:
                last = f
                out.append(f)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, key)}, "frame_n": out})

    return events.groupBy(*keys).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def possession(holders: DataFrame, need: int = 6) -> DataFrame:
    """Possession changes per match: a team must be nearest on ``need`` consecutive holder rows."""
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, n, held = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(pdfs)).sort_values("frame_n")
        out = []
        for f, team, pid in zip(rows.frame_n.tolist(), rows.team.tolist(), rows.player_id.tolist()):
            n = n + 1 if team == run else 1
            run = team
            if n == need and held != team:
                out.append((key[0], f, team, pid, held or "none"))
                held = team
        state.update((run, n, held))
        yield pd.DataFrame(out, columns=["match_id", "frame_n", "team", "player_id", "from_team"])

    return holders.groupBy("match_id").applyInPandasWithState(
        step, "match_id bigint, frame_n bigint, team string, player_id bigint, from_team string", "run string, n bigint, held string", "append", GroupStateTimeout.NoTimeout)


def _in_order(pdfs: Iterator[pd.DataFrame], at: str = "ms") -> pd.DataFrame:
    """One key's rows of a batch by time; as many as the files of one trigger hold."""
    return pd.concat(list(pdfs)).sort_values(at, kind="stable")


def absence(rows: DataFrame, keys: list[str], gap_s: float, schema: str, late: str = "1 seconds") -> DataFrame:
    """Alert once when a key is unseen for ``gap_s`` seconds, by event-time timer or at its return.

    The state is one number a key and leaves with the alert. Rows later than ``late`` behind the newest of earlier batches are
    dropped; the alerts do not depend on how rows fall into batches.
    """
    ms = int(gap_s * 1000)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(state.get[0])
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for t in _in_order(pdfs).ms.tolist():
                if last is not None and t - last >= ms:
                    out.append(last)
                last = t if last is None else max(t, last)
            state.update((last,))
            state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(keys, key)}, "last_seen_ms": out})

    d = rows.withWatermark("ts", late).select(*keys, "ts", F.unix_millis("ts").alias("ms"))
    return d.groupBy(*keys).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


#: Neighbouring track ids whose votes share one state.
VOTE_TRACKS = 256
#: Stands for a null key inside the arrays of a state.
NO_KEY = -(1 << 63)


def votes_with_ttl(reads: DataFrame, ttl_s: int, late: str = "1 seconds", tracks: int = VOTE_TRACKS) -> DataFrame:
    """Vote sums per (track, number) that are forgotten once over ``ttl_s`` seconds of event time pass without a read.

    A read after such a pause starts again from nothing, whether or not the timer has already taken the state away, so the sums do
    not depend on how reads fall into batches. Rows later than ``late`` behind the newest of earlier batches are dropped.
    ``tracks`` neighbouring track ids share one state, a set of arrays, as a call of Python costs far more than a read. Its timer
    runs for the oldest entry, and each call drops all entries whose pause is over.
    """
    ms = ttl_s * 1000

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get if state.exists else [[]] * 4, np.int64)
        new = np.empty((4, 0), np.int64) if state.hasTimedOut else pd.concat(list(pdfs))[["track_id", "number", "conf_pct", "ms"]].to_numpy(np.int64).T
        rows, fresh = np.concatenate([held, new], 1), np.arange(held.shape[1] + new.shape[1]) >= held.shape[1]
        order = np.lexsort((rows[3], fresh, rows[1], rows[0]))  # of each vote first what is held, then the reads by time
        (track, number, votes, at), fresh = rows[:, order], fresh[order]
        first = np.ones(len(at), bool)
        first[1:] = (track[1:] != track[:-1]) | (number[1:] != number[:-1])
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(at)) - 1
        seen = np.maximum(at, at[start][np.cumsum(first) - 1])
        again = first.copy()
        again[1:] |= at[1:] - seen[:-1] > ms
        stays = np.flatnonzero(again)
        total = np.add.reduceat(votes, stays)[np.searchsorted(stays, end, "right") - 1]
        track, number, last, touched = track[start], number[start], seen[end], fresh[end]
        mark = state.getCurrentWatermarkMs()
        alive = last + ms >= mark
        if alive.any():
            state.update(tuple(x[alive].tolist() for x in (track, number, total, last)))
            state.setTimeoutTimestamp(max(int(last[alive].min()) + ms, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"track_id": track[touched], "number": number[touched], "votes": total[touched]})

    d = reads.withWatermark("ts", late).select(
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(NO_KEY)).alias(c) for c in ("track_id", "number")], "ts", F.unix_millis("ts").alias("ms"), F.coalesce(F.col("conf_pct").cast("bigint"), F.lit(0)).alias("conf_pct"))
    near = d.withColumn("near", F.floor(F.col("track_id") / tracks)).groupBy("near")
    schema, held = "track_id bigint, number bigint, votes bigint", "track_id array<bigint>, number array<bigint>, total array<bigint>, last array<bigint>"
    votes = near.applyInPandasWithState(step, schema, held, "update", GroupStateTimeout.EventTimeTimeout)
    return votes.select(*[F.nullif(F.col(c), F.lit(NO_KEY)).alias(c) for c in ("track_id", "number")], "votes")


def goal_windows(goals: DataFrame, frames: DataFrame, before: str = "4 seconds", after: str = "1500 milliseconds", late: str = "60 days") -> DataFrame:
    """Frames around each goal as a stream-stream interval join with watermarks on both sides."""
    g = goals.withWatermark("goal_ts", late).alias("g")
    f = frames.withWatermark("frame_ts", late).alias("f")
    on = F.expr(f"g.match_id = f.match_id AND f.frame_ts >= g.goal_ts - interval {before} AND f.frame_ts <= g.goal_ts + interval {after}")
    return g.join(f, on).select("g.match_id", "g.event_id", "f.frame_n")


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int, str], None] | None = None) -> DataFrame:
    """Process what is there and stop; the result is a table in the shared folder.

    Append batches are added (a retried batch overwrites its own folder, so output is exactly
    once); complete batches replace the result; update batches keep their number.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        target = f"{root}/out/batch={0 if mode == 'complete' else batch}"
        (sink or (lambda d, _b, p: d.write.mode("overwrite").parquet(p)))(df, batch, target)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(_with_batch(stream)).parquet(f"{root}/out")


def _with_batch(stream: DataFrame):
    from pyspark.sql.types import IntegerType, StructType

    return StructType(list(stream.schema.fields)).add("batch", IntegerType())


def newest_rows(result: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode result: the latest batch of every key."""
    rest = [c for c in result.columns if c not in keys and c != "batch"]
    d = result.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return d.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
