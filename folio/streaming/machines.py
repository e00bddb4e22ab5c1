"""State machines over a key's rows in order of time, as streams with timers and as batch jobs.

A machine sees the rows of a key by time whatever batches and files they came in.  In a stream keys are dealt to buckets by
hash, and rows wait in the list state of their bucket until the watermark has passed them; a timer on the watermark releases them
in order.  A bucket's rows and states are read and written at once, as calls to the state store would cost more than the rows of most keys.  Rows that come
after the watermark has passed them are dropped by Spark, which counts them (``late_rows``).  A machine may ask for a deadline:
it is told when stream time passes it, also where no row of the key comes any more, and in the right place between rows.  With ``idle_s`` a
key's state is forgotten so long after its last row.

Stream time goes on with rows of any key, and with ticks: rows without a key that carry nothing but a time
(``with_ticks``).  A machine's results depend on rows, times and ticks only, so the batch twin, which is given the time up to which it
runs, has the same.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: Seconds that rows may be late.
LATE_S = 60
#: Parts that a stream's keys are dealt to by hash: a part's rows that wait and its keys' states are in memory together.
BUCKETS = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Machine:
    """``step(key, at, rows, state) -> rows out`` takes all rows of one time, in order of ``order``, and ``due(key, at, state) -> rows
    out`` a deadline that has come, before rows of the same time.  Both change the state, a dict of the fields of ``state``; the
    next deadline is its ``deadline`` (seconds; None: none)."""

    key: str
    columns: str
    output: str
    state: str
    start: dict
    step: Callable[[int, float, list[dict], dict], list[tuple]]
    due: Callable[[int, float, dict], list[tuple]] | None = None
    order: list[str] = field(default_factory=list)
    idle_s: float | None = None

    def run(self, key: int, rows: list[dict], state: dict, until: float) -> list[tuple]:
        """All that happens to a key up to a time: rows in order, deadlines and forgetting in between."""
        out: list[tuple] = []
        in_order = sorted(rows, key=lambda r: (r["at"], *[(r[c] is not None, r[c]) for c in self.order]))
        for at, now in groupby(in_order, key=lambda r: r["at"]):
            out += self._pass(key, state, at)
            out += self.step(key, at, list(now), state)
            if self.idle_s is not None:
                state["idle"] = at + self.idle_s
        return out + self._pass(key, state, until)

    def _pass(self, key: int, state: dict, at: float) -> list[tuple]:
        """Deadlines up to a time, and forgetting."""
        out = []
        while (when := self.next(state)) is not None and when <= at:
            if when == state["deadline"]:
                state["deadline"] = None
                out += self.due(key, when, state)
            else:
                state.update(self.fresh())
        return out

    @staticmethod
    def next(state: dict) -> float | None:
        times = [state[k] for k in ("idle", "deadline") if state.get(k) is not None]
        return min(times) if times else None

    def fresh(self) -> dict:
        return {**copy.deepcopy(self.start), "deadline": None, "idle": None}


def plain(part: pd.DataFrame) -> list[dict]:
    """Rows as Python values, nulls as None."""
    own = lambda x: x.tolist() if hasattr(x, "tolist") else None if x is pd.NaT or isinstance(x, float) and math.isnan(x) else x
    return [{c: own(v) for c, v in zip(part.columns, r)} for r in part.astype(object).itertuples(index=False, name=None)]


def _values(column: pd.Series, kind: T.DataType) -> list:
    """A column as Python values of its type, nulls as None: pandas makes floats of whole numbers that stand beside nulls."""
    to = int if isinstance(kind, T.IntegralType) else float if isinstance(kind, T.FractionalType) else list if isinstance(kind, T.ArrayType) else lambda x: x
    none = lambda x: x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x)
    return [None if none(x) else to(x) for x in column.astype(object).tolist()]


def _arrays(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])


class _Processor(StatefulProcessor):
    """A machine on Spark's state, for the keys of a bucket: rows that wait (a list of blocks, each an array a column), the keys' states
    (a value, an array a field), and one timer."""

    def __init__(self, machine: Machine, key: T.DataType, fields: list[str], names: list[str]):
        self.machine, self.fields, self.names = machine, fields, names
        # read here, as workers have no session to read them with
        own = lambda ddl: [T.StructField("_key", key), *T.StructType.fromDDL(ddl).fields]
        self.rows, self.states = own(", ".join(filter(None, ["at double", machine.columns]))), own(f"{machine.state}, deadline double, idle double")
        self.schemas = [_arrays(self.rows), _arrays(self.states), T.StructType.fromDDL("at long")]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.state = handle.getValueState("state", self.schemas[1])
        self.timer = handle.getValueState("timer", self.schemas[2])

    def _wake(self, at: float | None) -> None:
        """One timer a bucket, at the earliest time that matters."""
        held = self.timer.get()[0] if self.timer.exists() else None
        want = None if at is None else math.ceil(at * 1000)
        if held == want:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if want is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(want)
            self.timer.update((want,))

    def _advance(self, now_ms: int) -> Iterator[pd.DataFrame]:
        m, now = self.machine, now_ms / 1000
        ready, rest = {}, []
        for block in self.waiting.get():
            for r in zip(*block):
                if r[1] <= now:
                    ready.setdefault(r[0], []).append(dict(zip(("at", *self.fields), r[1:])))
                else:
                    rest.append(r)
        fields = self.schemas[1].names[1:]
        states = {r[0]: dict(zip(fields, r[1:])) for r in zip(*self.state.get())} if self.state.exists() else {}
        # what is due before the watermark can no longer be preceded by a row
        due = [key for key, state in states.items() if key not in ready and (at := m.next(state)) is not None and at <= now]
        out, fresh = [], m.fresh()
        for key in chain(ready, due):
            state = states.setdefault(key, m.fresh())
            out += m.run(key, ready.get(key, []), state, now)
            if state == fresh:
                del states[key]
        if ready:
            if rest:
                self.waiting.put([tuple(map(list, zip(*rest)))])
            else:
                self.waiting.clear()
        if not states:
            self.state.clear()
        elif ready or due:
            self.state.update(([*states], *([s[f] for s in states.values()] for f in fields)))
        times = [r[1] for r in rest] + [t for s in states.values() if (t := m.next(s)) is not None]
        self._wake(min(times, default=None))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # a tick: its time is in the watermark
            return
        first = math.inf
        for part in rows:
            part = part[part["at"].notna()]
            if len(part):
                self.waiting.appendValue(tuple(_values(part[c], f.dataType) for c, f in zip((self.machine.key, "at", *self.fields), self.rows)))
                first = min(first, float(part["at"].min()))
        if first < math.inf:
            held = self.timer.get()[0] if self.timer.exists() else None
            if held is None or math.ceil(first * 1000) < held:
                self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def run_machine(machine: Machine, rows: DataFrame, until: float = math.inf, late_s: float = LATE_S, buckets: int = BUCKETS) -> DataFrame:
    """The machine's output over a stream, or over a table up to the time ``until`` (seconds).

    rows: the machine's key and columns, and at double (seconds, above 0); rows without a key or a time change nothing.  buckets: of a
    stream, fixed once it has a checkpoint."""
    fields = [f.strip().split(" ")[0] for f in machine.columns.split(",") if f]
    names = [f.strip().split(" ")[0] for f in machine.output.split(",")]
    rows = rows.select(machine.key, "at", *fields)
    if rows.isStreaming:
        timed = rows.withColumn("_time", F.timestamp_millis(F.ceil(F.col("at") * 1000).cast("long"))).withWatermark("_time", f"{int(late_s * 1000)} milliseconds")
        schema = T.StructType.fromDDL(machine.output)
        bucket = F.when(F.col(machine.key).isNotNull(), F.pmod(F.xxhash64(machine.key), F.lit(buckets)))
        dealt = timed.withColumn("_bucket", bucket).groupBy("_bucket")
        return dealt.transformWithStateInPandas(_Processor(machine, rows.schema[machine.key].dataType, fields, names), schema, "Append", "EventTime")

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = [r for r in plain(part) if r["at"] <= until]  # later ones are not there yet
        return pd.DataFrame(machine.run(key[0], own, machine.fresh(), until), columns=names)

    return rows.where(F.col(machine.key).isNotNull() & F.col("at").isNotNull()).groupBy(machine.key).applyInPandas(whole, machine.output)


def with_ticks(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` and the ticks that ``tick`` puts into a folder."""
    ticks = rows.sparkSession.readStream.schema("at double").parquet(folder)
    return rows.unionByName(ticks, allowMissingColumns=True)


def tick(spark, folder: str, at: float | None) -> None:
    """Let stream time come to ``at`` (None: make the folder)."""
    spark.createDataFrame([(at,)] if at is not None else [], "at double").coalesce(1).write.mode("append").parquet(folder)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream has dropped as too late."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
