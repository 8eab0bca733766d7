"""Timed state of the streaming forms: results of late and out-of-order rows, and state that really leaves."""

import os
import random

from pyspark.sql import functions as F

from matchloom.streaming import live as L


def feed(spark, folder, batches, schema):
    """One file a batch, in order of time written."""
    for i, rows in enumerate(batches):
        path = f"{folder}/b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{path}/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_000_000 + i * 10, 1_000_000 + i * 10))
    raw = L.source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1)
    return raw.withColumn("ts", F.timestamp_millis("at"))


def run(stream, mode, folder):
    """Rows by batch, and how many keys hold state at the end."""
    out = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda d, b: out.extend((b, *r) for r in d.collect())).start()
    q.awaitTermination()
    return out, q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_absence_alerts_once_and_forgets(spark, tmp_path):
    batches = [[(1, 2000), (1, 1000), (2, 1000)], [(1, 10000), (3, 21000)], [(1, 1500), (2, 22000)]]  # (1, 1500) is too late
    rows = feed(spark, str(tmp_path), batches, "player_id long, at long")
    out, left = run(L.absence(rows, ["player_id"], 5.0, "player_id bigint, last_seen_ms bigint"), "append", str(tmp_path))
    assert sorted(r[1:] for r in out) == [(1, 2000), (1, 10000), (2, 1000)]
    assert left == 2  # players 2 and 3; the state of player 1 left with its alert


def test_votes_are_forgotten_after_a_pause(spark, tmp_path):
    base = 1_700_000_000_000  # a clock far from zero: the pause counts from the last read, not from the watermark
    s = lambda n: base + n * 1000
    batches = [[(1, 7, 60, s(5)), (1, 7, 50, s(0)), (2, 8, 90, s(0))], [(1, 7, 40, s(12)), (3, 9, 55, s(13))], [(1, 7, 70, s(40)), (2, 8, 80, s(41)), (3, 9, 99, s(1))], [(4, 1, 60, s(80))]]
    reads = feed(spark, str(tmp_path), batches, "track_id long, number long, conf_pct int, at long")
    out, left = run(L.votes_with_ttl(reads, 10), "update", str(tmp_path))
    seen = {}
    for _, track, _, votes in sorted(out):
        seen.setdefault(track, []).append(votes)
    assert seen == {1: [110, 150, 70], 2: [90, 80], 3: [55], 4: [60]}
    assert left == 1  # only track 4 was read within the last ten seconds


def test_votes_of_many_tracks_share_states_and_equal_a_loop(spark, tmp_path):
    rng = random.Random(3)
    reads = [(rng.randrange(400), rng.choice([7, 8, None]), rng.randrange(55, 100), rng.randrange(100) * 1000) for _ in range(3000)]
    batches = [[r for r in reads if lo <= r[3] < lo + 34_000] for lo in (0, 34_000, 68_000)]
    rows = feed(spark, str(tmp_path), [[(*r[:3], r[3] + 1_700_000_000_000) for r in b] for b in batches], "track_id long, number long, conf_pct int, at long")
    out, left = run(L.votes_with_ttl(rows, 20), "update", str(tmp_path))
    want, last = {}, {}
    for track, number, conf, at in sorted(reads, key=lambda r: r[3]):
        k = (track, number)
        want[k] = conf + (want[k] if k in want and at - last[k] <= 20_000 else 0)
        last[k] = at
    got = {}
    for _, track, number, votes in sorted(out, key=lambda r: r[0]):
        got[track, number] = votes
    assert got == want
    assert left == 2  # tracks 0 to 255 and 256 to 399: Python is called once for each, not once for each vote


def test_votes_of_one_state_leave_one_by_one(spark, tmp_path):
    batches = [[(1, 7, 60, 1000), (2, 8, 90, 9000)], [(2, 8, 50, 18000)], [(2, 8, 5, 19000), (2, 9, 4, 19500)]]
    rows = feed(spark, str(tmp_path), batches, "track_id long, number long, conf_pct int, at long")
    out, left = run(L.votes_with_ttl(rows, 10, tracks=1), "update", str(tmp_path))
    assert sorted(out)[-1][1:] == (2, 9, 4) and [r[3] for r in sorted(out) if r[1:3] == (2, 8)] == [90, 140, 145]
    assert left == 1  # track 1 has left; the two votes of track 2 are one state


def test_debounce_keeps_the_first_of_each_pause(spark, tmp_path):
    rows = feed(spark, str(tmp_path), [[(1, 3, 0), (1, 0, 0), (1, 9, 0)], [(1, 10, 0), (1, 19, 0), (2, 4, 0)], [(1, 30, 0)]], "match_id long, frame_n long, at long")
    out, left = run(L.debounce(rows, ["match_id"], 10, "match_id bigint, frame_n bigint"), "append", str(tmp_path))
    assert sorted(r[1:] for r in out) == [(1, 0), (1, 10), (1, 30), (2, 4)] and left == 2
