"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

Every participant of a conversation gets a rendering of the whole dialogue from its own side: its
turns are the assistant's, everyone else's are a named user's, and narrators (``system``) speak as
system for everybody and take no perspective.  The loss mask covers what the assistant says and
its closing mark.

A dialogue of up to ``PART`` turns is a single row.  A longer one is rendered in parts of ``PART`` turns each, in
order, so no row or task grows with the length of a conversation; ``begin`` is the
part's offset in the dialogue and the mask spans are offsets in the whole dialogue, in characters, so the parts'
texts put end to end are the dialogue.  Turns are numbered in two levels (runs of turn numbers, then within a
run), and the offsets are sums over rows of lengths, which hold no text.

Defined results: null text is empty; a null role is the participant ``unknown``; turns are in
order of number, then role, then text (null numbers first), repeated
turns all appear; a null conversation id is one conversation; a conversation of narrators alone has no
perspective and no row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Turns of a part.
PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    narrators: tuple[str, ...] = ("system",),
    part: int = PART,
) -> DataFrame:
    """conv_id, speaker, part, begin, n_turns, text, mask (array of start and end) by perspective."""
    conv = ["_c", "_null"]
    said = turns.select(
        F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("_c"),
        F.col(conv_id).isNull().alias("_null"),
        F.col(conv_id).alias("conv_id"),
        # a run of turn numbers; null numbers come before all
        F.coalesce(F.floor(F.col(turn) / part).cast("long"), F.lit(-(1 << 62))).alias("run"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("who"),
        F.coalesce(F.col(text), F.lit("")).alias("said"),
    )
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = said.groupBy(*conv, "run").agg(F.count("*").alias("n"))
    runs = runs.select(*conv, "run", F.coalesce(F.sum("n").over(earlier(conv, "run")), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*conv, "run").orderBy("turn", "who", "said"))
    placed = said.withColumn("_in", within).join(runs, [*conv, "run"])
    placed = placed.withColumn("at", F.col("_base") + F.col("_in") - 1).withColumn("part", F.floor(F.col("at") / part).cast("long"))
    parts = placed.groupBy(*conv, "part").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("at", "who", "said"))).alias("turns")
    )
    parts = keep(parts, "chat-parts")

    # lengths as everyone else sees a part, and how many turns a participant has in it
    others_head = F.when(F.col("who").isin(*narrators), F.lit(len("system"))).otherwise(F.char_length("who") + len("user name="))
    own = parts.select(*conv, "part", F.explode("turns").alias("t")).select(*conv, "part", F.col("t.who").alias("who"), F.char_length("t.said").alias("n"))
    own = own.groupBy(*conv, "part", "who").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    own = keep(own.withColumn("n", F.col("n") + F.col("k") * (others_head + len(OPEN) + 1 + len(CLOSE))), "chat-lengths")
    lengths = own.groupBy(*conv, "part").agg(F.sum("n").alias("n"))
    lengths = lengths.select(*conv, "part", F.coalesce(F.sum("n").over(earlier(conv, "part")), F.lit(0)).alias("_before"))
    people = own.where(~F.col("who").isin(*narrators)).select(*conv, "who").distinct()
    seats = lengths.join(people, conv).join(own.drop("n"), [*conv, "part", "who"], "left")
    # a speaker's own turns are headed by another word
    mine = F.coalesce(F.sum("k").over(earlier([*conv, "who"], "part")), F.lit(0))
    begin = F.col("_before") + mine * (len("assistant") - len("user name=") - F.char_length("who"))
    seats = seats.select(*conv, "part", F.col("who").alias("speaker"), begin.cast("long").alias("begin"))
    seen = parts.join(seats, [*conv, "part"])

    def head(t):
        own = F.when(t["who"] == F.col("speaker"), F.lit("assistant"))
        own = own.when(t["who"].isin(*narrators), F.lit("system"))
        return F.concat(F.lit(OPEN), own.otherwise(F.concat(F.lit("user name="), t["who"])), F.lit("\n"))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(head(t), t["said"], F.lit(CLOSE)).alias("piece"),
            F.char_length(head(t)).alias("skip"),
            (t["who"] == F.col("speaker")).alias("own"),
        ),
    )
    seen = seen.select("conv_id", "speaker", "part", "begin", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    seen = seen.withColumn("text", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))
    span = "struct<start:bigint,end:bigint>"
    start = F.struct(F.col("begin").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc, p):
        end = acc["at"] + F.char_length(p["piece"])
        mine = F.array(F.struct((acc["at"] + p["skip"]).alias("start"), end.alias("end")).cast(span))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("pieces", start, step, lambda acc: acc["spans"])
    return seen.select("conv_id", "speaker", "part", "begin", "n_turns", "text", mask.alias("mask"))


ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations),
s AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) - 1) // {PART} AS part FROM r),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM s WHERE who <> 'system'),
x AS (
  SELECT s.*, speaker, who = speaker AS own,
         '{OPEN}' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END
         || chr(10) AS head, said || '<|im_end|>' || chr(10) AS tail
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(tail)) OVER (
           PARTITION BY conv_id, speaker ORDER BY part, turn NULLS FIRST, who, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM x)
SELECT conv_id, speaker, part, CAST(min(pos0) AS BIGINT) AS "begin", count(*) AS n_turns,
       string_agg(head || tail, '' ORDER BY turn NULLS FIRST, who, said, pos0) AS text,
       coalesce(string_agg(CAST(CAST(pos0 + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos0 + length(head) + length(tail) AS BIGINT) AS VARCHAR), ',' ORDER BY pos0)
         FILTER (own), '') AS mask
FROM o GROUP BY conv_id, speaker, part"""
