"""Structured Streaming operators, each with a batch twin.

Those that depend on the order of a key's rows are machines (machines.py): rows are taken by time whatever files they came in,
and deadlines come without new rows.  Those that keep the latest or a sum for each key write a table by key (a
snapshot store): a micro-batch is merged into the buckets it touches, under its number, so that a repeated one changes nothing, and
nothing is kept in stream state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.sources.shared import shared_path
from folio.sources.snapshots import Store
from folio.streaming.machines import STATE_STORE, Machine, run_machine, tick, with_ticks  # noqa: F401

THROTTLE_S, ACTIVE_MIN, LEASE_S, STALL_POLLS, STALL_S, LIMIT = 30, 120, 180, 20, 60, 5


def timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is taken."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


# ---------------------------------------------------------------- machines


def heartbeats(throttle: int = THROTTLE_S, idle_s: float | None = None) -> Machine:
    """(book, at) beats that are written: the first, then those ``throttle`` seconds after the last one written.

    rows: book long, at double (seconds)."""

    def step(book, at, rows, state):
        if state["last"] is not None and at - state["last"] < throttle:
            return []
        state["last"] = at
        return [(book, at)]

    return Machine("book", "", "book long, at double", "last double", {"last": None}, step, idle_s=idle_s)


def claims(lease: int = LEASE_S, idle_s: float | None = None) -> Machine:
    """(page, id, at, event) of claim requests: granted or refused, and expired where a lease ends without a result.

    rows: page long, id long, at double, kind (claim, done, failed, pending).  A page that is done or failed, or under a
    lease, is refused; a lease that ends at the time of a claim has ended."""

    def step(page, at, rows, state):
        out = []
        for r in rows:
            if r["kind"] != "claim":
                state.update(status=r["kind"], deadline=None)
            elif state["status"] in ("done", "failed", "processing"):
                out.append((page, r["id"], at, "refused"))
            else:
                state.update(status="processing", holder=r["id"], deadline=at + lease)
                out.append((page, r["id"], at, "granted"))
        return out

    def expire(page, at, state):
        state["status"] = "expired"
        return [(page, state["holder"], at, "expired")]

    out = "page long, id long, at double, event string"
    return Machine("page", "id long, kind string", out, "status string, holder long", {"status": None, "holder": None}, step, expire, ["id", "kind"], idle_s)


def claimable(status, claimed_at, now, lease: int = LEASE_S) -> Column:
    """The claim rule on a stored page."""
    held = (F.col(status) == "processing") & F.coalesce(F.col(claimed_at) > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lease} SECONDS"), F.lit(False))
    return F.coalesce(~(F.col(status).isin("done", "failed") | held), F.lit(True))


def uploads(stall_s: float = STALL_S, polls: int = STALL_POLLS, idle_s: float | None = None) -> Machine:
    """(session, at, event): ready once when the files seen are those of the manifest; stalled when ``stall_s`` seconds, or
    ``polls`` polls, have passed with files present and no new one, and again after as many more.

    rows: session long, at double, kind (file, manifest, poll), name string of a file, names array of a manifest.  What
    has one time arrived together: files count before manifests and these before polls; of two manifests the last in order counts."""

    def step(session, at, rows, state):
        have = set(state["files"])
        new = {r["name"] for r in rows if r["kind"] == "file" and r["name"] is not None} - have
        lists = sorted(sorted(set(r["names"])) for r in rows if r["kind"] == "manifest" and r["names"] is not None)
        if new:
            state.update(files=sorted(have | new), polls=0, deadline=at + stall_s)
        if lists:
            state["manifest"] = lists[-1]
        if not state["done"] and state["manifest"] and state["manifest"] == state["files"]:
            state.update(done=True, deadline=None)
            return [(session, at, "ready")]
        state["polls"] += sum(r["kind"] == "poll" for r in rows)
        if state["done"]:
            state["deadline"] = None
        elif state["files"] and state["polls"] >= polls:
            return stall(session, at, state)
        return []

    def stall(session, at, state):
        state.update(polls=0, deadline=at + stall_s)
        return [(session, at, "stalled")]

    kinds = "files array<string>, manifest array<string>, polls int, done boolean"
    start = {"files": [], "manifest": [], "polls": 0, "done": False}
    return Machine("session", "kind string, name string, names array<string>", "session long, at double, event string", kinds, start, step, stall, ["kind"], idle_s)


def finished_jobs(idle_s: float | None = None) -> Machine:
    """(job, n) once for each job when all pages 1..n are terminal; n is the largest stated.  rows: job long, at double, page int,
    n int, terminal boolean."""

    def step(job, at, rows, state):
        if state["done"]:
            return []
        state["n"] = max([state["n"], *[r["n"] for r in rows if r["n"] is not None]])
        state["seen"] = sorted({*state["seen"], *[r["page"] for r in rows if r["terminal"] and r["page"] is not None and r["page"] >= 1]})
        if not state["n"] or sum(p <= state["n"] for p in state["seen"]) < state["n"]:
            return []
        state.update(done=True, seen=[])
        return [(job, state["n"])]

    start = {"seen": [], "n": 0, "done": False}
    return Machine("job", "page int, n int, terminal boolean", "job long, n int", "seen array<int>, n int, done boolean", start, step, idle_s=idle_s)


def streaks(limit: int = LIMIT, idle_s: float | None = None) -> Machine:
    """(job, id) where a job's failures in a row first reach the limit.  rows: job long, at double, id long, outcome (ok, fail, other)."""

    def step(job, at, rows, state):
        out = []
        for r in rows:
            if r["outcome"] == "ok":
                state["streak"] = 0
            elif r["outcome"] == "fail":
                state["streak"] += 1
                if state["streak"] == limit and not state["tripped"]:
                    state["tripped"] = True
                    out.append((job, r["id"]))
        return out

    return Machine("job", "id long, outcome string", "job long, id long", "streak int, tripped boolean", {"streak": 0, "tripped": False}, step, order=["id"], idle_s=idle_s)


# ---------------------------------------------------------------- tables by key


def sums(rows: DataFrame, time: str, unit: str, keys: list[str], metrics: list[str], count: str = "calls") -> DataFrame:
    """Partial sums by period and keys: they add up whatever batches the rows came in."""
    form = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH"}[unit]
    rows = timed(rows, time)
    out = rows.groupBy(F.date_format(time, form).alias(unit), F.date_trunc(unit, time).alias("_from"), *keys)
    return out.agg(F.count("*").alias(count), *[F.sum(m).alias(m) for m in metrics], F.max(time).alias("_last"))


def added(old: DataFrame, new: DataFrame, unit: str, keys: list[str], metrics: list[str], count: str = "calls") -> DataFrame:
    """Two tables of partial sums as one."""
    total = [F.sum(m).alias(m) for m in (count, *metrics)]
    return old.unionByName(new).groupBy(unit, "_from", *keys).agg(*total, F.max("_last").alias("_last"))


def marked(table: DataFrame, unit: str, late: str = "1 hour") -> DataFrame:
    """Sums with ``final``: no row of the period can come any more, as the newest row of all is ``late`` after its end."""
    newest = table.agg(F.max("_last").alias("_newest"))  # one row
    final = F.col("_from") + F.expr(f"INTERVAL 1 {unit}") <= F.col("_newest") - F.expr(f"INTERVAL {late}")
    return table.crossJoin(F.broadcast(newest)).withColumn("final", final).drop("_from", "_last", "_newest")


def latest_activity(records: DataFrame, book: str, time: str, counts: Column) -> DataFrame:
    """(book, last): the last counted time of each book."""
    return timed(records, time).where(counts).groupBy(book).agg(F.max(time).alias("last"))


def recently_active(latest: DataFrame, now: str, minutes: int = ACTIVE_MIN) -> DataFrame:
    """latest with ``active``: last >= now - minutes, the edge included; no time is not active."""
    edge = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return latest.withColumn("active", F.coalesce(F.col("last") >= edge, F.lit(False)))


def error_log(errors: DataFrame, time: str) -> DataFrame:
    """Errors as rows of an append-only table by day."""
    return timed(errors, time).withColumn("day", F.date_format(time, "yyyy-MM-dd"))


def page_outcomes(events: DataFrame, keys: list[str], time: str, outcome: str) -> DataFrame:
    """(keys, outcome, at): the latest outcome; of equal times the largest."""
    return timed(events, time).groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("at"), F.col(outcome).alias("outcome"))).alias("x")).select(*keys, "x.*")


# ---------------------------------------------------------------- running


def _ended(stream: DataFrame, start: Callable[[object], StreamingQuery]) -> StreamingQuery:
    """Run a stream over what is there now."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)  # timers and lists need it; a query keeps what was set when it started
    try:
        query = start(stream.writeStream.trigger(availableNow=True))
    finally:
        conf.set(name, before) if before else conf.unset(name)
    query.awaitTermination()
    return query


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process what a stream has now into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    path, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    _ended(stream, lambda w: w.option("checkpointLocation", state).format("parquet").option("path", path).outputMode("append").start())
    return spark.read.schema(stream.schema).parquet(path)


def run_machine_to(machine: Machine, rows: DataFrame, until: float, name: str, late_s: float = 60) -> tuple[DataFrame, StreamingQuery]:
    """(output, query) of a machine over what a stream has now, after stream time has come to ``until`` by a tick."""
    spark = rows.sparkSession
    path, state, ticks = (shared_path(spark, f"{name}{x}") for x in ("", "-state", "-ticks"))
    tick(spark, ticks, None)
    out = run_machine(machine, with_ticks(rows, ticks), late_s=late_s)
    start = lambda w: w.option("checkpointLocation", state).format("parquet").option("path", path).outputMode("append").start()
    query = _ended(out, start)
    tick(spark, ticks, until + late_s)
    _ended(out, start)
    return spark.read.schema(out.schema).parquet(path), query


def run_into(stream: DataFrame, store: Store, table: str, key: str, reduce: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame, DataFrame], DataFrame], state: str | None = None) -> DataFrame:
    """Merge what a stream has now into a table by key, and read it.

    Each micro-batch is reduced and merged under its number by the writer ``table``: one that comes twice changes nothing."""
    state = state or shared_path(stream.sparkSession, f"{table}-state")

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Store(batch.sparkSession, store.path).merge(table, key, reduce(batch), resolve, table, number)

    _ended(stream, lambda w: w.option("checkpointLocation", state).foreachBatch(one).start())
    return store.read(table)
