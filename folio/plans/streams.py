"""Queries of streams (T1 - T9): each reads its table as a stream of files and runs to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.registry import Tables, query
from folio.sources.shared import shared_path
from folio.sources.snapshots import Store
from folio.streaming import operators as o


def stream(t: Tables, name: str):
    """A table of the folder as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t._dir)


def seconds(c):
    return F.col(c).cast("timestamp").cast("double")


#: A time after all events, to which stream time comes in the end, and the first second of the made-up times below.
END, BASE = 2_000_000_000.0, 1_000_000_000.0


def _store(t: Tables, name: str) -> Store:
    return Store(t.spark, shared_path(t.spark, name))


def _sums(t: Tables, rows, unit: str, keys: list[str], metrics: list[str], count: str):
    """A stream's sums by period, all of them, with ``final``."""
    table = o.run_into(
        rows, _store(t, "sums"), "sums", unit, lambda df: o.sums(df, "ts", unit, keys, metrics, count), lambda a, b: o.added(a, b, unit, keys, metrics, count)
    )
    return o.marked(table, unit)


@query(
    "t1_usage_by_day",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS event_id,
    date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS final FROM events GROUP BY 1, 2""",
)
def t1(t):
    return _sums(t, stream(t, "events"), "day", ["event_type"], ["event_id"], "calls")


@query("t2_heartbeats")
def t2(t):
    """Depends on the last beat written; tests hold the stream against its batch twin and a loop."""
    beats = stream(t, "events").select(F.col("user_id").alias("book"), (BASE + seconds("ts") % 7200).alias("at"))
    return o.run_machine_to(o.heartbeats(), beats, END, "beats", late_s=7200)[0]


@query(
    "t3_recently_active",
    """SELECT user_id, CAST(max(ts) FILTER (event_type = 'view') AS VARCHAR) IS NOT NULL AS seen, max(ts) >= TIMESTAMP '2024-01-16 10:00:00' AS active
    FROM events WHERE event_type = 'view' GROUP BY user_id""",
)
def t3(t):
    views = stream(t, "events").where("event_type = 'view'")
    last = lambda a, b: a.unionByName(b).groupBy("user_id").agg(F.max("last").alias("last"))
    table = o.run_into(views, _store(t, "active"), "active", "user_id", lambda df: o.latest_activity(df, "user_id", "ts", F.lit(True)), last)
    return o.recently_active(table, "2024-01-16 12:00:00").select("user_id", F.lit(True).alias("seen"), "active")


def _requests(rows):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "pending").otherwise("claim")
    return rows.select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), seconds("ts").alias("at"), kind.alias("kind"))


@query("t4_claims")
def t4(t):
    """A state machine over each page's requests; tests hold the stream against its batch twin and a loop."""
    out, _ = o.run_machine_to(o.claims(3600), _requests(stream(t, "events")), END, "claims", late_s=3600)
    return out.where("event != 'expired'").select("page", "id", (F.col("event") == "granted").alias("granted"))


@query("t4_leases")
def t4_leases(t):
    """Leases that end without a result, by the clock; tests hold the stream against its batch twin and a loop."""
    out, _ = o.run_machine_to(o.claims(3600), _requests(stream(t, "events")), END, "leases", late_s=3600)
    return out.where("event = 'expired'").select("page", "id", "at")


def _items(t):
    none = F.lit(None).cast("array<string>").alias("names")
    at = lambda s: F.lit(BASE + s).alias("at")
    files = stream(t, "lineitem").select(F.col("l_orderkey").alias("session"), at(0), F.lit("file").alias("kind"), F.col("l_linenumber").cast("string").alias("name"), none)
    k = (F.col("o_custkey") % 5).cast("int")
    names = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    manifests = stream(t, "orders").select(F.col("o_orderkey").alias("session"), at(1), F.lit("manifest").alias("kind"), F.lit(None).cast("string").alias("name"), names.alias("names"))
    return files.unionByName(manifests)


@query(
    "t5_uploads",
    """WITH h AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))) AS have FROM lineitem GROUP BY 1),
    r AS (SELECT l_orderkey AS session, coalesce(o_custkey % 5 > 0 AND have = list_transform(range(1, 1 + o_custkey % 5), lambda x: CAST(x AS VARCHAR)), false) AS ready
      FROM h LEFT JOIN orders ON l_orderkey = o_orderkey)
    SELECT session, 'ready' AS event FROM r WHERE ready UNION ALL SELECT session, 'stalled' FROM r WHERE NOT ready""",
)
def t5(t):
    """Sessions whose files are those of the manifest, and those that nothing came for in a minute: no row tells of that."""
    return o.run_machine_to(o.uploads(), _items(t), BASE + 61, "uploads", late_s=60)[0].select("session", "event")


@query(
    "t6_finished_jobs",
    """WITH r AS (SELECT l_orderkey, 1 + CAST(l_orderkey % 3 AS INTEGER) AS n, l_linenumber, l_returnflag FROM lineitem)
    SELECT l_orderkey AS job, n FROM r WHERE l_returnflag <> 'N' AND l_linenumber BETWEEN 1 AND n GROUP BY l_orderkey, n HAVING count(DISTINCT l_linenumber) = n""",
)
def t6(t):
    n = (1 + F.col("l_orderkey") % 3).cast("int")
    at = (BASE + F.col("l_linenumber")).alias("at")
    results = stream(t, "lineitem").select(F.col("l_orderkey").alias("job"), at, F.col("l_linenumber").cast("int").alias("page"), n.alias("n"), (F.col("l_returnflag") != "N").alias("terminal"))
    return o.run_machine_to(o.finished_jobs(), results, END, "jobs")[0]


@query(
    "t7_error_counts",
    """SELECT strftime(ts, '%Y-%m-%d %H') AS hour, user_id % 3 AS flow, count(*) AS n,
    date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 1 HOUR AS final
    FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
)
def t7(t):
    errors = stream(t, "events").where("event_type = 'error'").withColumn("flow", F.col("user_id") % 3)
    return _sums(t, errors, "hour", ["flow"], [], "n")


@query("t7_error_log", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, props FROM events WHERE event_type = 'error'")
def t7_log(t):
    errors = stream(t, "events").where("event_type = 'error'").select("event_id", "user_id", "ts", "props")
    return o.run_to_end(o.error_log(errors, "ts"), "error-log").drop("ts")


@query(
    "t8_page_outcomes",
    """SELECT user_id, arg_max(event_type, ts) AS outcome, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "at" FROM events GROUP BY user_id""",
)
def t8(t):
    latest = lambda a, b: o.page_outcomes(a.unionByName(b), ["user_id"], "at", "outcome")
    table = o.run_into(stream(t, "events"), _store(t, "outcomes"), "outcomes", "user_id", lambda df: o.page_outcomes(df, ["user_id"], "ts", "event_type"), latest)
    return table.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "t9_streaks",
    """WITH r AS (SELECT user_id, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error', 'click')),
    i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM i WHERE NOT ok)
    SELECT user_id AS job, min(event_id) AS id FROM n WHERE n = 5 GROUP BY user_id""",
)
def t9(t):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type").isin("error", "click"), "fail").otherwise("neutral")
    at = (BASE + F.col("event_id").cast("double")).alias("at")
    calls = stream(t, "events").select(F.col("user_id").alias("job"), at, F.col("event_id").alias("id"), outcome.alias("outcome"))
    return o.run_machine_to(o.streaks(), calls, END, "streaks")[0]
