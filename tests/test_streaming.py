"""Streams over several files: the sweep emits each position once, drops late rows and keeps bounded state."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellweave.streaming import windows


def test_sweep(spark, tmp_path):
    schema = "tid int, pos int, base int, qual int"
    parts = [[(t, p, (p + k) % 4, 20 + k) for p in range(a, a + 300) for k in range(3)] for t in (0, 1) for a in (0, 280, 560)]
    parts[4].append((0, 5, 1, 30))  # far behind the line
    parts += [[(windows.LAST_CONTIG + k, 0, 0, 0)] for k in (0, 1)]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part-{i}")
        name = next(f for f in os.listdir(f"{tmp_path}/part-{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/part-{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1000 + i, 1000 + i))
    bases = windows.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    q = windows.to_files(windows.sweep(bases, slack=100), f"{tmp_path}/out", f"{tmp_path}/state")
    got = Counter({(r.tid, r.pos, r.base): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)  # each once
    want = Counter((t, p, b) for rows in parts[:-2] for t, p, b, _ in rows)
    want[0, 5, 1] -= 1
    assert (+(want - got), +(got - want), windows.late_rows(q)) == (Counter(), Counter(), 1)
    with pytest.raises(ValueError, match="out of order"):
        windows.late_rows(q, strict=True)
    steps = windows.progress(q)
    assert len(steps) >= len(parts) and max(s[3] for s in steps) < len(want) / 2


def test_late_events(spark, tmp_path):
    """Windows of a stream equal those of the batch, but for events later than the watermark; repeats within it go."""
    rows = [(f"2024-01-01 {h:02}:{m:02}:00", "a", 1.0, h) for h in range(0, 8) for m in (5, 35)]
    batches = [rows[:8], rows[8:], [("2024-01-01 00:10:00", "a", 1.0, 99), ("2024-01-01 07:50:00", "a", 1.0, 7)]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "ts string, event_type string, value double, user_id int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and os.path.getmtime(f"{tmp_path}/in/{f}") > 10_000:
                os.utime(f"{tmp_path}/in/{f}", (1000 + i, 1000 + i))
    events = windows.stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    q = windows.to_files(windows.tumbling(events, late="30 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.start.hour: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # 07:50 was in the last batch, so that the line stands at 07:05 for all that was emitted
    assert got == {h: 2 for h in range(7)} and windows.late_rows(q) == 1
    once = windows.to_files(windows.deduplicated(events, ["user_id"], "2 hours").select("user_id"), f"{tmp_path}/once", f"{tmp_path}/once-state")
    assert Counter(r.user_id for r in spark.read.parquet(f"{tmp_path}/once").collect()) == Counter(range(8)) and windows.late_rows(once) >= 1
