"""Stream operators against plain loops, with the input arriving in two parts and the query restarted between them."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import feeds, states


def parts(spark, small, folder):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    middle = sorted(r["ts"] for r in events.select("ts").collect())[events.count() // 2]
    rows = sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"]))
    yield rows
    for cond in (events["ts"] < middle, events["ts"] >= middle):
        events.where(cond).coalesce(1).write.mode("append").parquet(folder)
        yield


def drained_twice(spark, small, tmp_path, make):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    steps = parts(spark, small, folder)
    rows = next(steps)
    for _ in steps:
        got = feeds.drained(make(feeds.source(spark, folder)), out, state)
    return rows, [tuple(r) for r in got.collect()]


def test_rate_limit_anchors_at_first_row(spark, small, tmp_path):
    rows, got = drained_twice(spark, small, tmp_path, lambda s: feeds.rate_limited(s, "user_id", 6 * 3600, 2))
    start, n, want = {}, {}, []
    for r in rows:
        u = r["user_id"]
        if u not in start or (r["ts"] - start[u]).total_seconds() >= 6 * 3600:
            start[u], n[u] = r["ts"], 0
        n[u] += 1
        want.append((r["event_id"], n[u] <= 2))
    assert sorted(got) == sorted(want) and {a for _, a in want} == {True, False}


def test_changes(spark, small, tmp_path):
    rows, got = drained_twice(spark, small, tmp_path, lambda s: feeds.changes(s, "user_id", "event_type"))
    last, want = {}, []
    for r in rows:
        if last.get(r["user_id"]) != r["event_type"]:
            want.append((r["event_id"],))
        last[r["user_id"]] = r["event_type"]
    assert sorted(got) == sorted(want)


def test_once_drops_repeated_jobs(spark, small, tmp_path):
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(folder)
    got = feeds.drained(feeds.once(feeds.source(spark, folder), "event_id", "60 days"), out, state)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in events.collect())


MIN = 60_000


def fed(spark, tmp_path, batches, make, schema="event_id long, ts timestamp, user_id long, event_type string, value double", fails=()):
    """The stream's rows after each batch of (event_id, minute, user_id, event_type, value); a new query, as after a restart, for each."""
    import datetime

    own, folder, out, state = states.stateful(spark), *(f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    start = datetime.datetime(2024, 1, 1)
    for batch in batches:
        rows = [(i, None if m is None else start + datetime.timedelta(minutes=m), *rest) for i, m, *rest in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = feeds.drained(make(own.readStream.schema(schema).parquet(folder)), out, state)
        yield [tuple(r) for r in got.collect()]


def state_rows(spark, tmp_path, name):
    return states.stateful(spark).read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", name).load()


def test_stalls_fire_without_a_row_for_the_key(spark, tmp_path):
    base = 1704067200000
    batches = [
        [(1, 0, 1, "work", 1.0), (2, 5, 2, "work", 1.0), (3, 6, 3, "done", 1.0), (4, None, 4, "work", 1.0)],
        [(5, 40, 9, "work", 1.0)],  # 30 minutes without 1 and 2
        [(6, 50, 2, "work", 1.0), (7, 75, 9, "work", 1.0)],  # 1 stalls again, 2 has news
        [(8, 200, 9, "done", 1.0)],  # 1 fails and is forgotten, 2 goes through all its attempts
        [(9, 400, 8, "done", 1.0)],
    ]
    steps = fed(spark, tmp_path, batches, lambda s: states.stalled(s, "user_id", F.col("event_type") == "done", 30, 2))
    want = [
        [],
        [(1, "requeue", 1, 30), (2, "requeue", 1, 35)],
        [(1, "requeue", 2, 60)],
        [(1, "fail", 3, 90), (2, "requeue", 2, 80), (2, "fail", 3, 110)],
        [],
    ]
    seen = []
    for got, new in zip(steps, want):
        seen += [(u, a, n, base + m * MIN) for u, a, n, m in new]
        assert sorted(got) == sorted(seen)
    assert state_rows(spark, tmp_path, "state").count() == 0  # the failed and the finished are forgotten


def test_expiry_waits_for_budget_floor_and_silence(spark, tmp_path):
    base = 1704067200000
    batches = [[(1, 0, 1, "x", 10.0), (2, 0, 2, "x", 100.0)], [(3, 29, 1, "x", 0.0), (4, 31, 9, "x", 0.0)], [(5, 40, 9, "x", 0.0)], [(6, 151, 9, "x", 500.0)]]
    steps = list(fed(spark, tmp_path, batches, lambda s: states.expired(s, "user_id", F.col("value"), 90.0, 1800, 600)))
    # 1: floor of 30 minutes, but news at 29, so 39; 2: 100 * 90 s = 150 minutes
    assert [sorted(s) for s in steps[:3]] == [[], [], [(1, base + 39 * MIN)]] and sorted(steps[3]) == [(1, base + 39 * MIN), (2, base + 150 * MIN)]


def test_cache_entries_live_from_their_store_and_leave_the_state(spark, tmp_path):
    batches = [[(1, 0, 1, "x", 0.0), (2, 9, 1, "x", 0.0), (3, 0, 2, "x", 0.0)], [(4, 11, 1, "x", 0.0), (5, 20, 1, "x", 0.0), (6, 21, 1, "x", 0.0)], [(7, 300, 3, "x", 0.0)]]
    *_, got = fed(spark, tmp_path, batches, lambda s: states.until(s, "user_id", F.lit(True), 600))
    assert sorted(got) == [(1, False), (2, True), (3, False), (4, False), (5, True), (6, True), (7, False)]
    assert {r["key"]["user_id"] for r in state_rows(spark, tmp_path, "state").collect()} <= {3}


def test_a_failed_key_is_passed_over_for_its_cooldown(spark, tmp_path):
    batches = [[(1, 0, 1, "error", 0.0), (2, 5, 1, "error", 0.0)], [(3, 9, 1, "ok", 0.0), (4, 11, 1, "ok", 0.0), (5, 12, 1, "error", 0.0), (6, 21, 1, "ok", 0.0), (7, 23, 1, "ok", 0.0)]]
    *_, got = fed(spark, tmp_path, batches, lambda s: states.until(s, "user_id", F.col("event_type") == "error", 600))
    assert sorted(got) == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, True), (7, False)]


def test_retention_never_holds_more_than_its_bound(spark, tmp_path):
    batches = [[(i, 0, i % 2, "x", 0.0) for i in range(k, k + 30)] for k in (0, 30, 60)]
    for n, got in enumerate(fed(spark, tmp_path, batches, lambda s: states.retired(s, "user_id", 5)), 1):
        ids = range(30 * n)
        assert sorted(i for _, i in got) == [i for i in ids if i < 30 * n - 10]
        held = state_rows(spark, tmp_path, "entries")
        assert held.count() <= (2 if "list_value" in held.columns else 10)


def test_a_killed_backfill_leaves_each_row_once(spark, tmp_path):
    """The run fails between the write and the commit of its second batch; the next one writes that batch in its place."""
    folder, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for k in range(4):
        spark.range(25 * k, 25 * k + 25).coalesce(1).write.mode("append").parquet(folder)
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)

    def dies(batch):
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        states.backfill(source(), out, state, 1, dies)
    states.backfill(source(), out, state, 2, rows_a_file=10)
    states.backfill(source(), out, state, 3)
    got = spark.read.parquet(f"{out}/*")
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    assert {r["run"]: r["count"] for r in got.groupBy("run").count().collect()} == {1: 25, 2: 75}
    sizes = got.where("run = 2").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes <= 10
