"""Folds with a state: the same steps in plain loops, in batch and over streams; late rows."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import guards, serves
from waymark.streaming import refold, state

ACT = "session_id long, at double, seq long, act string, lat double, lng double, accuracy double, place_id long, ranked array<long>"


def acts(seed=1, sessions=4, n=70):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        at, lat = 1000.0 * s, 59.33
        rows.append((s, at, 0, "start", None if s == 3 else lat, None if s == 3 else 18.07, None, None, None))
        for k in range(1, n):
            at += rng.choice([5, 30, 70, 200, 1000])
            act = rng.choice(["pull", "pull", "pull", "fix", "fix", "dismiss", "dismiss", "more", "refresh", "browse", "unknown"])
            if k == n - 5 and s % 2:
                act = "end"
            lat += rng.choice([0, 0, 0.001, 0.006])
            ranked = rng.sample(range(40), rng.choice([0, 2, 30]))
            rows.append((s, at, k, act, lat if act == "fix" else None, 18.07 if act == "fix" else None, rng.choice([None, 10.0, 3000.0]) if act == "fix" else None, rng.randrange(40) if act in ("dismiss", "browse") else None, ranked))
    return rows


def plain_serves(rows):
    """The rules of serving, told once more over lists of cards."""
    out = []
    for s in sorted({r[0] for r in rows}):
        origin, live, batches, gone, fix, dry, stamps = None, True, [], set(), None, None, set()
        for _, at, seq, act, lat, lng, acc, place, ranked in sorted((r for r in rows if r[0] == s), key=lambda r: r[2]):
            ranked, batch, reason, new, anchor, picks = ranked or [], batches[-1] if batches else None, None, False, None, []
            alive = [c for c in batch["cards"] if c not in gone] if batch else []
            fresh = [p for p in ranked if p not in gone][:10]
            rest = [p for p in ranked if p not in gone and not (batch and p in batch["cards"])]
            room = len(stamps) < 20
            if act == "start":
                origin = (lat, lng) if lat is not None else None
            elif act == "end":
                live = False
            elif act == "dismiss":
                gone.add(place)
            elif act == "fix":
                fix = (at, (lat, lng), acc)
            elif act == "pull" and batch is None:
                if origin:
                    reason, new, anchor, picks = "initial", True, origin, fresh
            elif act == "pull" and live:
                far = fix and at - fix[0] <= 900 and batch["anchor"] and geo.metres(*batch["anchor"], *fix[1]) >= max(400.0, fix[2] or 0.0)
                if far and room and (dry is None or at >= dry) and at - batch["first"] >= 120:
                    if fresh and at - batch["last"] >= 120:
                        reason, new, anchor, picks = "move_reanchor", True, fix[1], fresh
                    else:
                        dry = at + 120
                if reason is None and len(alive) < 10 and origin:
                    reason, picks = "dismiss_backfill", rest[: 10 - len(alive)]
            elif act == "refresh" and live and room:
                here = fix[1] if fix and at - fix[0] <= 900 else origin
                if here:
                    reason, new, anchor, picks = "manual_refresh", True, here, fresh
            elif act == "more" and batch and live and origin and room:
                reason, picks = "more", rest[:10]
            elif act == "browse" and origin and live and place in ranked and not (batch and place in batch["cards"]):
                reason, new, anchor, picks = "browse", batch is None, origin, [place]
            if picks:
                if new:
                    batches.append({"cards": [], "anchor": anchor, "first": at, "last": at})
                batch = batches[-1]
                for p in picks:
                    batch["cards"].append(p)
                    out.append((s, seq, at, reason, len(batches), len(batch["cards"]), p))
                batch["last"] = at
                stamps.add(at)
    return out


def drained(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    was = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in was.items():
        spark.conf.set(name, value)


def staged(spark, rows, schema, key, path, parts):
    """The rows as files, each of a part of every key's rows in order; the stream reads one file a batch."""
    for k in range(parts):
        part = [r for r in rows if r[key] * parts // (1 + max(x[key] for x in rows)) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_serves_in_batch_and_over_a_stream(spark, tmp_path, rocks):
    rows = acts()
    want = sorted(plain_serves(rows))
    d = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), ACT)
    assert sorted(map(tuple, serves.replayed(d).collect())) == want
    assert {r[3] for r in want} == set(serves.REASONS)
    assert serves.replayed(d.limit(0)).count() == 0
    stream = staged(spark, rows, ACT, 2, str(tmp_path / "acts"), 2)
    assert sorted(map(tuple, drained(spark, state.served_stream(stream), "served").collect())) == want


def test_breaker_in_batch_and_over_a_stream(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows, at = [], 0.0
    for k in range(300):
        at += rng.choice([1, 10, 60, 130])
        rows.append((rng.choice("ab"), k, at, rng.random() < 0.15))
    want = []
    for key in "ab":
        streak, until = [], -1.0
        for _, k, t, ok in (r for r in rows if r[0] == key):
            if t < until:
                want.append((k, "skipped"))
            elif ok:
                streak = []
                want.append((k, "called"))
            else:
                streak = [*streak, t] if streak and t < streak[-1] + 120 else [t]
                want.append((k, "opened" if len(streak) == 5 else "failed"))
                if len(streak) == 5:
                    streak, until = [], t + 120
    schema = "source string, seq long, at double, ok boolean"
    d = spark.createDataFrame(rows, schema)
    got = guards.decided(d, ["source"], ("seq",), ("at", "ok"), guards.breaker, "string")
    assert sorted((r.seq, r.decision) for r in got.collect()) == sorted(want)
    assert {"called", "failed", "opened", "skipped"} == {w for _, w in want}
    stream = staged(spark, rows, schema, 1, str(tmp_path / "calls"), 2)
    assert sorted((r.seq, r.decision) for r in drained(spark, state.guarded_stream(stream), "guarded").collect()) == sorted(want)


def test_latch_and_quota():
    fires, last = [], None
    for t in (0.0, 5.0, 10.0, 12.0, 20.0, 31.0):
        last, now = guards.latch(last, t, 10.0)
        fires.append(now)
    assert fires == [True, False, True, False, True, True]
    granted, times = [], None
    for t in (0.0, 1.0, 2.0, 3.0, 100.0, 101.0, 102.0):
        times, now = guards.quota(times, t, 3, 100.0)
        granted.append(now)
    assert granted == [True, True, True, False, False, True, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_give_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, f"2026-08-0{1 + k % 4}", rng.randrange(3), v, float(10 * k + v)) for k in range(40) for v in range(rng.choice([1, 2]))]
    schema = "id long, day string, user long, version int, value double"

    def fold(d):
        return d.groupBy("user", "day").agg(F.count("*").alias("n"), F.sum("value").alias("value"))

    newest = {r[0]: r for r in rows}
    want = sorted((r.user, r.day, r.n, r.value) for r in fold(spark.createDataFrame(list(newest.values()), schema)).collect())
    rng.shuffle(rows)
    merge = refold.refolded(str(tmp_path / "raw"), str(tmp_path / "out"), ["id"], "version", "day", fold)
    path = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3] + rows[:2], schema).coalesce(1).write.mode("append").parquet(path)
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(merge).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    merge(spark.createDataFrame(rows[:5], schema), 9)  # again
    merge(spark.createDataFrame([], schema), 10)
    assert sorted((r.user, r.day, r.n, r.value) for r in spark.read.parquet(str(tmp_path / "out")).select("user", F.col("day").cast("string").alias("day"), "n", "value").collect()) == want
