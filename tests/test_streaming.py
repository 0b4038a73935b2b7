from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waymark.operators import trajectory
from waymark.streaming import jobs


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}")


def test_streams_agree_with_batch(spark, tmp_path):
    t0 = datetime(2026, 8, 1, 10)
    rows = [(i, t0 + timedelta(minutes=5 * i), 1 + i % 2, 59.3 + (i // 20) * 0.05, 18.0 + (i % 3) * 1e-5) for i in range(80)]
    rows.append((999, t0 + timedelta(days=3), 3, 59.0, 17.0))  # moves the watermark
    fixes = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, lat double, lng double")
    path = str(tmp_path / "fixes")
    fixes.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(fixes.schema).parquet(path)
    own = fixes.where("user_id < 3")
    want = {(r.user_id, r.ts) for r in trajectory.throttled(own, ["user_id"]).collect()}
    got = {(r.user_id, r.ts) for r in drained(spark, jobs.throttled_stream(stream), "thr").collect() if r.user_id < 3}
    assert got == want
    want = {(r.user_id, r.started, r.ended, r.fixes) for r in trajectory.dwells(own).collect()}
    got = {(r.user_id, r.started, r.ended, r.fixes) for r in drained(spark, jobs.dwell_stream(stream), "dw").collect()}
    assert got <= want and len(got) >= len(want) - 2  # the last dwell of a user may wait for its timeout
    assert drained(spark, jobs.once_per_place(stream), "once").count() > 0


def test_admission_and_one_event_a_place(spark, tmp_path):
    t0 = datetime(2026, 8, 1, 10)
    rows = [(1, 1, t0, 59.3301, 18.0701, "home"), (2, 1, t0 + timedelta(seconds=20), 59.33012, 18.07011, "home"), (3, 1, t0 + timedelta(seconds=30), 59.34, 18.08, "far"), (4, 2, t0, 59.3301, 18.0701, "home"), (5, 3, t0, 59.0, 18.0, "x")]
    e = spark.createDataFrame([(i, u, 10 * u, t, a, o, c) for i, u, t, a, o, c in rows], "event_id long, user_id long, session_id long, ts timestamp, lat double, lng double, cell string")
    live = spark.createDataFrame([(10,), (20,)], "session_id long")
    homes = spark.createDataFrame([(1, "home")], "user_id long, cell string")
    got = {r.event_id: (r.lat, r.cell) for r in jobs.admitted(e, live, homes).collect()}
    assert got == {1: (None, "home"), 2: (None, "home"), 3: (59.34, "far"), 4: (59.3301, "home")}
    path = str(tmp_path / "e")
    e.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    once = {(r.user_id, round(r.lat, 3), round(r.lng, 3)) for r in drained(spark, jobs.once_per_place(stream), "once2").collect()}
    assert once == {(1, 59.33, 18.07), (1, 59.34, 18.08), (2, 59.33, 18.07), (3, 59.0, 18.0)}
    assert spark.table("once2").count() == 4
    counts = drained(spark, jobs.windowed_counts(stream.withColumn("event_type", F.col("cell"))), "wc", "update").collect()
    assert {(r.event_type, r.n) for r in counts} == {("home", 3), ("far", 1), ("x", 1)}
