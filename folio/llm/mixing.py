"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a hashed order and cut, end to end, into blocks of equal
token counts (``BLOCK``, or a 64th of a smaller source).  A source's slots are as many as bring its words nearest to its
target.  The mix is a row of slots, one block each.  Slot k has the golden-ratio point
frac((k + 1/2) * phi); that point, looked up in the cumulative shares of the slots, names its source, so
any stretch of the mix holds the sources nearly in proportion.  Slots are ranked within their
source, and the r-th slot takes block r modulo the number of blocks: sources are passed through
whole, again and again.  Where the points give a source a few slots too many or too few, the last ones are left
out or added at the end.

Targets: sources in code point order (null last) weigh 5, 2, 1 and so on again, and share all
tokens; a target over ``max_repeats`` times its source's size stops there and its excess is
shared by weight among the rest.

Prefix sums and ranks are taken in two levels (pieces of a source, then within a piece), so a
source with a third of all rows is spread over many tasks.  The driver and every task hold a few numbers for each source.

Defined results: null or blank texts have size 0 and take nothing; a source without tokens has
target 0; ties in the hashed order are broken by id and text, equal rows are interchangeable;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fresh, keep

BLOCK = 64
#: Pieces of a source for two-level sums; and slots of the schedule that are ranked together.
PIECES, RUN = 4096, 1 << 16
WEIGHTS = (5, 2, 1)
#: frac(phi) and frac(2**20 * phi) for the golden ratio phi, so that large slot numbers stay exact.
_PHI, _PHI20 = 0.6180339887498949, 0.607787409740351
N_WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, max_repeats: int = 3) -> dict[str | None, float]:
    """Target tokens of each source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        left = total - sum(out.values())
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= max_repeats * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        out |= {s: float(max_repeats * sizes[s]) for s in full}
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass(frozen=True)
class Share:
    """A source's part of the mix: its slots and the length and number of its blocks."""

    size: int
    target: float
    block: int
    blocks: int
    slots: int


def share_of(size: int, target: float, block: int, max_repeats: int) -> Share:
    if not size:
        return Share(0, target, 1, 0, 0)
    length = min(block, -(-size // 64))
    blocks = -(-size // length)
    passes = min(int(target // size), max_repeats)
    rest = min(target - passes * size, size) if passes < max_repeats else 0.0
    return Share(size, target, length, blocks, passes * blocks + min(round(rest / length), blocks))


def mix_sources(
    docs: DataFrame,
    seed: int = 17,
    block: int = BLOCK,
    max_repeats: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(rows, schedule): rows has doc_id, size, source, source_size, target, taken, text_crc32;
    schedule has slot, source, block, turn: which block the mix reads at each slot."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.regexp_count(body, F.lit(N_WORDS)).cast("long").alias("size"),
        F.col(source).alias("source"),
        F.crc32(F.encode(body, "UTF-8")).alias("_crc"),
    )
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "_crc", F.lit(seed)))
    rows = keep(rows.withColumn("_piece", F.pmod(F.shiftright("_h", 40), F.lit(PIECES)).cast("int")), "mix-rows")
    pieces = rows.groupBy("source", "_piece").agg(F.sum("size").alias("n"))
    pieces = keep(pieces, "mix-pieces")
    sizes = {r.source: r.n for r in pieces.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    goal = targets(sizes, max_repeats=max_repeats)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    shares = [share_of(sizes[s], goal[s], block, max_repeats) for s in names]
    kinds = "_source int, source string, source_size long, target double, _length long, _blocks long, _slots long"
    facts = [(i, s, x.size, x.target, x.block, x.blocks, x.slots) for i, (s, x) in enumerate(zip(names, shares, strict=True))]
    facts = spark.createDataFrame(facts, kinds)

    # where each document's tokens begin in its source's hashed order
    before = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("source", "_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_piece").orderBy("_h", "doc_id", "_crc", "size")
    begun = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = (F.col("r.source").eqNullSafe(F.col("s.source"))) & (F.col("r._piece") == F.col("s._piece"))
    placed = rows.withColumn("_in", begun).alias("r").join(starts.alias("s"), same)
    placed = placed.select("r.doc_id", "r.size", "r.source", "r._crc", (F.col("_base") + F.col("_in")).alias("_from"))
    placed = placed.alias("p").join(facts.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")))
    placed = placed.select("p.*", "_source", "source_size", "target", "_length")

    schedule = _schedule(spark, shares, facts)
    times = keep(schedule.groupBy("_source", "block").agg(F.count("*").alias("times")), "mix-times")
    # the pieces of documents that lie in one block meet the number of times it is read
    length = F.col("_length")
    first, last = F.floor(F.col("_from") / length), F.floor((F.col("_from") + F.col("size") - 1) / length)
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * length) - F.greatest(
        F.col("_from"), F.col("block") * length
    )
    # (source, _from) names a document with tokens: no two begin at the same token
    parts = parts.select("_source", "_from", "block", inside.alias("_n")).join(times, ["_source", "block"])
    taken = parts.groupBy("_source", "_from").agg(F.sum(F.col("_n") * F.col("times")).alias("taken"))
    taken = taken.withColumn("_some", F.lit(True))
    out = placed.withColumn("_some", F.col("size") > 0).join(taken, ["_source", "_from", "_some"], "left")
    out = out.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.col("_crc").alias("text_crc32"),
    )
    return out, schedule.join(facts.select("_source", "source"), "_source").select("slot", "source", "block", "turn")


def _schedule(spark, shares: list[Share], facts: DataFrame) -> DataFrame:
    """Slots of the mix with their source, block and turn."""
    slots = np.cumsum([x.slots for x in shares]) if shares else np.zeros(0, np.int64)
    total = int(slots[-1]) if len(slots) else 0
    edges = spark.sparkContext.broadcast(slots / max(total, 1))

    def sources(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            high, low = slot >> 20, slot & ((1 << 20) - 1)
            point = (high * _PHI20 % 1.0 + low * _PHI + 0.5 * _PHI) % 1.0
            # of sources without slots none is found: their edge is the one before
            found = np.minimum(np.searchsorted(edges.value, point, side="right"), np.searchsorted(edges.value, edges.value[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["slot", "_source"])

    slots = spark.range(total).toDF("slot").mapInArrow(sources, "slot long, _source int")
    slots = slots.withColumn("_run", F.floor(F.col("slot") / RUN))
    counts = keep(slots.groupBy("_source", "_run").agg(F.count("*").alias("n")), "mix-runs")
    before = Window.partitionBy("_source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_source", "_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    bases = bases.join(facts.select("_source", "_blocks", "_slots"), "_source")
    rank = F.row_number().over(Window.partitionBy("_source", "_run").orderBy("slot")) - 1
    ranked = slots.withColumn("_in", rank).join(bases, ["_source", "_run"])
    ranked = ranked.select("slot", "_source", (F.col("_base") + F.col("_in")).alias("_rank"), "_blocks", "_slots").where("_rank < _slots")
    # what the points did not give a source follows the last slot
    got = facts.join(counts.groupBy("_source").agg(F.sum("n").alias("n")), "_source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = got.where("n < _slots").select("_source", "_blocks", "_slots", F.explode(F.sequence("n", F.col("_slots") - 1)).alias("_rank"))
    short = short.select((F.lit(total) + F.col("_source") + F.col("_rank") * max(len(shares), 1)).alias("slot"), "_source", "_rank", "_blocks", "_slots")
    ranked = ranked.unionByName(short)
    turn = F.floor(F.col("_rank") / F.col("_blocks")).cast("long")
    return ranked.select("slot", "_source", F.pmod("_rank", "_blocks").alias("block"), turn.alias("turn"))


def mixed_documents(
    docs: DataFrame, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """``docs`` as the mix has them: each row as often as its words are taken, rounded by its hash.

    A document of which the mix takes 1.4 times its words stands once, and twice with a chance of
    0.4; texts without words are not in the mix.
    """
    rows, _ = mix_sources(docs, seed, doc_id=doc_id, text=text, source=source, **options)
    rate = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")).agg(
        F.try_divide(F.sum("taken"), F.sum("size")).alias("rate")
    )
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "crc"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = rate.select("id", "crc", F.floor(F.col("rate") + chance).cast("int").alias("copies")).where("copies > 0")
    id_, crc_, copies_, copy_ = fresh(docs.columns, "id", "crc", "copies", "copy")
    copies = keep(copies, "mix-copies").toDF(id_, crc_, copies_)
    # as many copies as documents: no side of this join is small at any size that matters
    joined = docs.join(copies.hint("merge"), F.col(doc_id).eqNullSafe(F.col(id_)) & (crc == F.col(crc_)))
    return joined.withColumn(copy_, F.explode(F.sequence(F.lit(1), copies_))).select(*[F.col(f"`{c}`") for c in docs.columns])
