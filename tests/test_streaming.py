"""Streams against their batch twins and loops: several micro-batches, files in any order, late rows, deadlines without rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.sources.snapshots import Store
from folio.streaming import machines as m
from folio.streaming import operators as o

LATE = 300.0


@pytest.fixture()
def split(spark, tmp_path):
    """Rows (times in their second place) as a stream of three files, each a micro-batch; rows come up to LATE seconds late."""

    def make(rows, schema, late=LATE):
        rng = random.Random(5)
        df = spark.createDataFrame(rows, schema)
        come = sorted(rows, key=lambda r: r[1] + rng.random() * (late - 1))
        third = -(-len(rows) // 3)
        for k in range(3):
            part = come[k * third : (k + 1) * third]
            spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    return make


def same(machine, df, stream, until=100_000.0):
    out, _ = o.run_machine_to(machine, stream, until, "test", LATE)
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(map(tuple, m.run_machine(machine, df, until).collect()))
    return rows


def test_heartbeats_in_any_order(split):
    rng = random.Random(1)
    rows = sorted([(b, float(1000 + rng.randrange(2000))) for b in range(4) for _ in range(25)], key=lambda r: r[1])
    got = same(o.heartbeats(), *split(rows, "book long, at double"))
    want, last = [], {}
    for b, at in rows:
        if b not in last or at - last[b] >= 30:
            last[b] = at
            want.append((b, at))
    assert got == sorted(want)


def test_claims_and_leases(split):
    rng = random.Random(2)
    rows = [(rng.randrange(3), float(1000 + i * 50), i, rng.choice(["claim", "claim", "claim", "done", "failed", "pending"])) for i in range(90)]
    got = same(o.claims(), *split(rows, "page long, at double, id long, kind string"))
    state, want = {}, []
    for page, at, i, kind in rows:
        for other, (status, since, holder) in list(state.items()):
            if status == "processing" and since + 180 <= at:
                want.append((other, holder, since + 180, "expired"))
                state[other] = ("expired", since, holder)
        status, _, _ = state.get(page, (None, 0, 0))
        if kind != "claim":
            state[page] = (kind, at, i)
        elif status in ("done", "failed", "processing"):
            want.append((page, i, at, "refused"))
        else:
            state[page] = ("processing", at, i)
            want.append((page, i, at, "granted"))
    want += [(page, holder, since + 180, "expired") for page, (status, since, holder) in state.items() if status == "processing"]
    assert got == sorted(want)


def test_a_lease_and_a_stall_end_without_a_row(spark, split):
    df, stream = split([(7, 1000.0, 1, "claim")], "page long, at double, id long, kind string")
    out, query = o.run_machine_to(o.claims(), stream, 1179.0, "lease", LATE)
    assert [tuple(r) for r in out.collect()] == [(7, 1, 1000.0, "granted")]
    assert sorted(map(tuple, m.run_machine(o.claims(), df, 1180.0).collect())) == [(7, 1, 1000.0, "granted"), (7, 1, 1180.0, "expired")]
    df, stream = spark.createDataFrame([(1, 1000.0, "file", "a", None)], UPLOADS), None
    assert [tuple(r) for r in m.run_machine(o.uploads(), df, 1059.0).collect()] == []
    assert [tuple(r) for r in m.run_machine(o.uploads(), df, 1125.0).collect()] == [(1, 1060.0, "stalled"), (1, 1120.0, "stalled")]


def test_ticks_move_stream_time(split, spark, tmp_path):
    """The lease's end comes with a tick, in a run that has no row; so does forgetting."""
    _, stream = split([(7, 1000.0, 1, "claim")], "page long, at double, id long, kind string")
    path, ticks = f"{tmp_path}/out", f"{tmp_path}/ticks"
    m.tick(spark, ticks, None)
    out = m.run_machine(o.claims(idle_s=500.0), m.with_ticks(stream, ticks), late_s=10)

    def run():
        o._ended(out, lambda w: w.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", path).start())
        kept = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").count()
        return [tuple(r) for r in spark.read.schema(out.schema).parquet(path).orderBy("at").collect()], kept("state")

    assert run() == ([], 0)  # waits: a row before it may still come
    m.tick(spark, ticks, 1100.0)
    granted, expired = (7, 1, 1000.0, "granted"), (7, 1, 1180.0, "expired")
    assert run() == ([granted], 1)
    m.tick(spark, ticks, 1191.0)
    assert run() == ([granted, expired], 1)
    m.tick(spark, ticks, 1600.0)
    assert run() == ([granted, expired], 0)  # idle: the key is forgotten


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "book long, at double"
    # a batch's rows are held against the watermark of the batch before it
    for part in ([(1, 1000.0), (1, 5000.0)], [(1, 5100.0), (1, 4000.0)], [(1, 2000.0), (2, 100.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, query = o.run_machine_to(o.heartbeats(), stream, 9000.0, "late", 60)
    assert sorted(map(tuple, out.collect())) == [(1, 1000.0), (1, 4000.0), (1, 5000.0), (1, 5100.0)]
    assert m.late_rows(query) == 2


def test_idle_state_is_forgotten(spark):
    rows = [(1, 1000.0), (1, 1020.0), (1, 1049.0), (2, 1000.0)]
    df = spark.createDataFrame(rows, "book long, at double")
    # ten idle seconds end the throttle: every beat is written
    assert m.run_machine(o.heartbeats(idle_s=10.0), df).count() == 4
    assert m.run_machine(o.heartbeats(), df).count() == 3


def test_lease_edges(spark):
    now = "2025-01-01 12:00:00"
    rows = [(1, "processing", "2025-01-01 11:57:00"), (2, "processing", "2025-01-01 11:57:01"), (3, "processing", None), (4, "done", None), (5, None, None), (6, "pending", now)]
    df = spark.createDataFrame(rows, "k int, s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert {r.k: r.c for r in df.select("k", o.claimable("s", "t", now).alias("c")).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_activity_edges(spark):
    rows = [(1, "2025-01-01 10:00:00"), (2, "2025-01-01 09:59:59"), (3, None), (4, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp").alias("last"))
    assert {r.k: r.active for r in o.recently_active(df, "2025-01-01 12:00:00").collect()} == {1: True, 2: False, 3: False, 4: True}


def test_streaks_in_any_order(split):
    rng = random.Random(3)
    rows = [(i % 3, float(1000 + 20 * i), i, rng.choice(["fail", "fail", "fail", "fail", "ok", "other"])) for i in range(120)]
    got = same(o.streaks(), *split(rows, "job long, at double, id long, outcome string"))
    runs, want = Counter(), {}
    for job, _, i, outcome in rows:
        runs[job] = 0 if outcome == "ok" else runs[job] + (outcome == "fail")
        if outcome == "fail" and runs[job] == 5:
            want.setdefault(job, i)
    assert got == sorted(want.items())


def test_finished_jobs_once(split):
    rows = [(1, 1.0, 1, 2, True), (2, 2.0, 1, 3, True), (1, 3.0, 2, 2, True), (2, 4.0, 2, 3, False), (1, 5.0, 1, 2, True), (3, 6.0, 9, 1, True), (4, 7.0, None, None, None)]
    assert same(o.finished_jobs(), *split(rows, "job long, at double, page int, n int, terminal boolean")) == [(1, 2)]


UPLOADS = "session long, at double, kind string, name string, names array<string>"


def test_uploads_wait_for_the_manifest(split):
    rows = [
        (1, 1000.0, "file", "a", None),
        (2, 1001.0, "file", "a", None),
        (1, 1002.0, "manifest", None, ["b", "a"]),
        (3, 1003.0, "manifest", None, []),
        (1, 1004.0, "file", "b", None),
        (3, 1005.0, "file", "x", None),
    ]
    got = same(o.uploads(), *split(rows, UPLOADS), until=1062.0)
    assert got == [(1, 1004.0, "ready"), (2, 1061.0, "stalled")]


def test_uploads_stall_by_polls(spark):
    rows = [(1, 1000.0, "file", "a", None)] * 10 + [(1, float(1001 + k), "poll", None, None) for k in range(20)]
    df = spark.createDataFrame(rows, UPLOADS)
    assert [tuple(r) for r in m.run_machine(o.uploads(), df, 1030.0).collect()] == [(1, 1020.0, "stalled")]


def test_sums_are_whole_and_tell_what_is_final(spark, split, tmp_path):
    rows = [(f"2025-01-0{d} 0{h}:30:00", float(d * 24 + h), "m", 1) for d in (1, 2, 3) for h in range(4)]
    df, stream = split(rows, "t string, at double, model string, n int", late=30)
    store = Store(spark, f"file://{tmp_path}/store")
    args = ("day", ["model"], ["n"])
    table = o.run_into(stream, store, "sums", "day", lambda b: o.sums(b, "t", *args), lambda a, b: o.added(a, b, *args))
    assert store.version() == 3
    got = sorted((r.day, r.calls, r.n, r.final) for r in o.marked(table, "day").collect())
    assert got == [("2025-01-01", 4, 4, True), ("2025-01-02", 4, 4, True), ("2025-01-03", 4, 4, False)]
    assert got == sorted((r.day, r.calls, r.n, r.final) for r in o.marked(o.sums(df, "t", *args), "day").collect())


def test_a_repeated_batch_changes_nothing(spark, split, tmp_path):
    rows = [(k % 3, float(k), f"2025-01-01 00:00:{k:02d}", "done" if k % 2 else "failed") for k in range(30)]
    df, stream = split(rows, "page long, at0 double, t string, outcome string", late=10)
    store = Store(spark, f"file://{tmp_path}/store")
    latest = lambda a, b: o.page_outcomes(a.unionByName(b), ["page"], "at", "outcome")
    reduce = lambda b: o.page_outcomes(b, ["page"], "t", "outcome")
    o.run_into(stream, store, "outcomes", "page", reduce, latest, f"{tmp_path}/state")
    once = sorted(map(tuple, store.read("outcomes").collect()))
    assert once == sorted(map(tuple, o.page_outcomes(df, ["page"], "t", "outcome").collect()))
    before = store.version()
    # the stream's own progress is lost: it runs through all batches again
    o.run_into(stream, store, "outcomes", "page", reduce, latest, f"{tmp_path}/state-2")
    assert store.version() == before and sorted(map(tuple, store.read("outcomes").collect())) == once


def test_keys_share_a_buckets_state(spark, split, tmp_path):
    """State is called for a bucket, not for a key; nulls beside whole numbers stay whole numbers and nulls."""
    rows = [(k, float(1000 + p), p, None if p == 1 else 3, True) for k in range(200) for p in (1, 2, 3)] + [(k, 1001.0, None, None, None) for k in range(0, 400, 3)]
    df, stream = split(rows, "job long, at double, page int, n int, terminal boolean", late=2)
    path, ticks = f"{tmp_path}/out", f"{tmp_path}/ticks"
    m.tick(spark, ticks, None)
    out = m.run_machine(o.finished_jobs(), m.with_ticks(stream, ticks), late_s=10, buckets=8)
    start = lambda w: w.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", path).start()
    o._ended(out, start)
    kept = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").count()
    assert kept("timer") == 8
    m.tick(spark, ticks, 2000.0)
    o._ended(out, start)
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(path).collect()))
    assert got == [(k, 3) for k in range(200)] == sorted(map(tuple, m.run_machine(o.finished_jobs(), df).collect()))
    assert kept("state") == 8 and kept("waiting") == 0
