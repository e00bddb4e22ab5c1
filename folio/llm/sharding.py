"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records are hashed into a fixed number of virtual slots (thousands; a parameter).  Bytes and
rows are summed per slot, and a map from slot to shard is stored as a table whose versions are
kept: version 0 deals the slots round, every later version edits the one before.  Rebalancing
moves whole slots, so a change of plan moves few records and never needs a new hash.

What the driver holds is the slot table: one row per slot, bounded by ``slots``.  Everything
that grows with the input (hashing, sums, numbering) stays in Spark.  Numbers within a shard
come from a rank inside the virtual slot plus the slot's offset, so no task sees a whole shard.

Law: ``bytes``.  Records of equal text are one unit: a slot is taken by the hash of the text's bytes, so copies lie in one
slot and one shard.  Only a text whose copies are larger than a shard's fair share cannot stay whole: its rows are spread by the hash
of their ids over ``SPREAD`` slots of its own, beyond the others (at most ``shards`` texts are as large as that).

Numbers within a slot are given in ``PARTS`` parts by the hash of the id, so that a slot of many copies is numbered by many
tasks.  ``docs`` is read three times: give a table.

Defined results: null text has no bytes; null ids and repeated rows are placed by their hash
like any other; one record larger than a fair share fills a shard by itself; an empty table
gives an empty result; columns named in ``carry`` come along, but those named size, text_crc32, vslot, shard or slot in any case
give way to the ones added.
"""

from __future__ import annotations

import heapq
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .scratch import fresh, new_path

SLOTS = 8192
#: Slots of a text whose copies are larger than a shard, and parts in which a slot is numbered.
SPREAD, PARTS = 1024, 16
ADDED = ("size", "text_crc32", "vslot", "shard", "slot")
MAP_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("version", "vslot", "shard", "bytes", "rows", "offset")]
)


class SlotMap:
    """The versions of a slot-to-shard map, stored as one Parquet folder per version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slotmap")
        self.versions: list[int] = []

    def write(self, slots: list[dict]) -> int:
        version = len(self.versions)
        offsets: dict[int, int] = {}
        for s in slots:
            s["version"], s["offset"] = version, offsets.get(s["shard"], 0)
            offsets[s["shard"]] = s["offset"] + s["rows"]
        frame = pd.DataFrame(slots, columns=MAP_SCHEMA.names)
        self.spark.createDataFrame(frame, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={version:06d}")
        self.versions.append(version)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = self.versions[-1] if version is None else version
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version:06d}")


def rebalance(slots: list[dict], shards: int) -> list[dict]:
    """Edit a map so that bytes are near equal and few slots move.

    Shards over the mean give up slots, largest first while they exceed it; the freed slots go,
    largest first, to the emptiest shard; a last pass swaps or moves slots between the fullest
    and the emptiest shard while that narrows the spread.
    """
    total = sum(s["bytes"] for s in slots)
    mean = total / shards
    load, by = [0] * shards, [[] for _ in range(shards)]
    for s in slots:
        if s["shard"] < shards:
            load[s["shard"]] += s["bytes"]
            by[s["shard"]].append(s)
    freed = [s for s in slots if s["shard"] >= shards]
    for k in range(shards):
        by[k].sort(key=lambda s: (s["bytes"], s["vslot"]))
        keep_, held = [], 0
        for s in by[k]:
            if held + s["bytes"] <= mean or not s["bytes"]:
                held += s["bytes"]
                keep_.append(s)
            else:
                freed.append(s)
        by[k], load[k] = keep_, held
    heap = [(load[k], k) for k in range(shards)]
    heapq.heapify(heap)
    for s in sorted(freed, key=lambda s: (-s["bytes"], s["vslot"])):
        held, k = heapq.heappop(heap)
        s["shard"] = k
        by[k].append(s)
        load[k] = held + s["bytes"]
        heapq.heappush(heap, (load[k], k))
    for _ in range(64 * shards):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        best = min(
            ((abs(gap - 2 * s["bytes"]), s["vslot"], s, None) for s in by[hi] if 0 < s["bytes"] < gap),
            default=None,
            key=lambda x: x[:2],
        )
        small = sorted((s for s in by[lo]), key=lambda s: (s["bytes"], s["vslot"]))
        sizes = [s["bytes"] for s in small]
        for s in by[hi]:
            want = s["bytes"] - gap / 2
            k = _near(sizes, want)
            if k is not None and 0 < (d := s["bytes"] - sizes[k]) < gap and (best is None or abs(gap - 2 * d) < best[0]):
                best = (abs(gap - 2 * d), s["vslot"], s, small[k])
        if best is None or best[0] >= gap:
            break
        _, _, out, back = best
        by[hi].remove(out)
        by[lo].append(out)
        out["shard"] = lo
        load[hi] -= out["bytes"]
        load[lo] += out["bytes"]
        if back:
            by[lo].remove(back)
            by[hi].append(back)
            back["shard"] = hi
            load[hi] += back["bytes"]
            load[lo] -= back["bytes"]
    return slots


def _near(sizes: list[int], want: float) -> int | None:
    from bisect import bisect_left

    if not sizes:
        return None
    k = bisect_left(sizes, want)
    return min((i for i in (k - 1, k) if 0 <= i < len(sizes)), key=lambda i: abs(sizes[i] - want))


def shard_records(
    docs: DataFrame, shards: int = 24, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None
) -> tuple[DataFrame, SlotMap]:
    """Place every row; returns the placed rows and the map's versions (0: initial, 1: rebalanced).

    Rows: the columns of ``carry`` (None: all), size, text_crc32, vslot, shard, slot (gapless position within the shard).
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    ident, size, crc, key, vslot, part, rank, of, own = fresh([*docs.columns, *ADDED], "ident", "size", "crc", "key", "vslot", "part", "rank", "of", "own")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{doc_id}`").alias(ident),
        (F.octet_length(body) + 8).cast("long").alias(size),
        F.crc32(F.encode(body, "UTF-8")).alias(crc),
        F.xxhash64(body).alias(key),
    )
    plain = F.pmod(F.col(key), F.lit(slots)).cast("long")

    def sums(of: Column, which: DataFrame) -> dict[int, tuple[int, int]]:
        return {r.v: (r.bytes, r.rows) for r in which.groupBy(of.alias("v")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect()}

    by_slot = sums(plain, rows)  # one row for each slot
    fair = sum(b for b, _ in by_slot.values()) / shards
    heavy: list[int] = []
    if full := [v for v, (b, _) in by_slot.items() if b > fair]:
        # texts larger than a fair share: at most ``shards``
        large = rows.where(plain.isin(full)).groupBy(key).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > fair) & (F.col("rows") > 1))
        heavy = sorted(r[0] for r in large.collect())
    place = plain
    for k, h in enumerate(heavy):
        spread = slots + k * SPREAD + F.pmod(F.xxhash64(ident, key), F.lit(SPREAD)).cast("long")
        place = F.when(F.col(key) == h, spread).otherwise(place)
    rows = rows.withColumn(vslot, place).withColumn(part, F.pmod(F.xxhash64(ident, F.lit("part")), F.lit(PARTS)).cast("int"))
    # one row for each part of a slot: bounded by the parameters
    counts = rows.groupBy(vslot, part).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).toArrow().sort_by([(vslot, "ascending"), (part, "ascending")])
    total = slots + SPREAD * len(heavy)
    table = [{"vslot": v, "shard": v % shards, "bytes": 0, "rows": 0} for v in range(total)]
    before = []
    for v, b, n in zip(counts[vslot].to_pylist(), counts["bytes"].to_pylist(), counts["rows"].to_pylist()):
        before.append(table[v]["rows"])
        table[v]["bytes"] += b
        table[v]["rows"] += n
    slot_map = SlotMap(spark)
    slot_map.write(table)
    slot_map.write(rebalance(table, shards))
    shard_of, offset_of = {s["vslot"]: s["shard"] for s in table}, {s["vslot"]: s["offset"] for s in table}
    at = counts[vslot].to_pylist()
    current = spark.createDataFrame(
        pa.table(
            {
                vslot: counts[vslot],
                part: counts[part],
                of: pa.array([shard_of[v] for v in at], pa.int32()),
                own: pa.array([offset_of[v] + b for v, b in zip(at, before)], pa.int64()),
            }
        )
    )
    order = Window.partitionBy(vslot, part).orderBy(F.asc_nulls_first(ident), crc, size)
    # a row for each part of a slot: safe to broadcast
    placed = rows.withColumn(rank, F.row_number().over(order) - 1).join(F.broadcast(current), [vslot, part])
    return (
        placed.select(
            *[F.col(f"`{c}`") for c in kept],
            F.col(size).alias("size"),
            F.col(crc).alias("text_crc32"),
            F.col(vslot).alias("vslot"),
            F.col(of).alias("shard"),
            (F.col(own) + F.col(rank)).cast("long").alias("slot"),
        ),
        slot_map,
    )


def crc32(text: str | None) -> int:
    """What text_crc32 holds; for tests."""
    return zlib.crc32((text or "").encode())
