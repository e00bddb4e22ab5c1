"""Ordered operators: neighbours, splits, numbering, breakers, samples.

Every window is partitioned by a book, session or key; none orders a whole table in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.ordering import numbered
from folio.sources.shared import shared_path

TEXT_LAYER_MIN = 20
#: Notes that stand for a neighbour without text.
FIRST_PAGE, LAST_PAGE = "(first story page)", "(last story page)"
NO_TEXT_BEFORE, NO_TEXT_AFTER = "(previous story page has no text)", "(next story page has no text)"

#: Places of a key that are looked at together.
PIECE = 1_000_000


def neighbour_context(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """Story pages with previous and next text, or a note: at the book's edge, or a page without text."""
    w = Window.partitionBy(book).orderBy(page)
    body = F.coalesce(text, F.lit(""))

    def side(shifted: Column, at_edge: Column, edge: str, empty: str) -> Column:
        return F.when(at_edge, edge).when(shifted == "", empty).otherwise(shifted)

    before, after = F.lag(body).over(w), F.lead(body).over(w)
    return pages.withColumns(
        {
            "previous": side(before, before.isNull(), FIRST_PAGE, NO_TEXT_BEFORE),
            "next": side(after, after.isNull(), LAST_PAGE, NO_TEXT_AFTER),
        }
    )


def has_layer(text) -> Column:
    return F.char_length(F.trim(F.coalesce(text, F.lit("")))) >= TEXT_LAYER_MIN


def flanked(pages: DataFrame, book: str, page: str, layer: str) -> DataFrame:
    """Story pages with ``flanked``: inside the story, with a text layer on both neighbours."""
    w = Window.partitionBy(book).orderBy(page)
    both = F.coalesce(F.lag(layer).over(w), F.lit(False)) & F.coalesce(F.lead(layer).over(w), F.lit(False))
    return pages.withColumn("flanked", both)


def routed(pages: DataFrame, book: str, page: str, text: str, story: str, flows: str, missing: str) -> DataFrame:
    """Where a page's text comes from: layer, skipped_wordless, ocr, or none outside the story."""
    from folio.functions.columns import skip_ocr

    inside = flanked(pages.where(F.col(story)).withColumn("_layer", has_layer(text)), book, page, "_layer")
    source = F.when(F.col("_layer"), "layer").when(F.col("flanked") & skip_ocr(flows, missing), "skipped_wordless").otherwise("ocr")
    inside = inside.withColumn("text_source", source).drop("_layer", "flanked")
    outside = pages.where(~F.coalesce(story, F.lit(False)))
    return inside.unionByName(outside.withColumn("text_source", F.when(has_layer(text), "layer").otherwise("none")))


def is_separator(mean, p99) -> Column:
    return (F.col(mean) < 10) & (F.col(p99) < 40)


def split_at_separators(frames: DataFrame, session: str, order: str, separator: Column) -> DataFrame:
    """Frames with ``group`` 1, 2, ...; separators end a group and are dropped, empty groups vanish."""
    w = Window.partitionBy(session).orderBy(order)
    marked = frames.withColumn("_sep", separator).withColumn("_n", F.sum(F.col("_sep").cast("int")).over(w))
    kept = marked.where(~F.col("_sep"))
    return kept.withColumn("group", F.dense_rank().over(Window.partitionBy(session).orderBy("_n"))).drop("_sep", "_n")


def split_at_covers(frames: DataFrame, session: str, order: str, cover: Column) -> DataFrame:
    """Frames with ``group`` and ``single``: a new group at every cover but the first row."""
    w = Window.partitionBy(session).orderBy(order)
    first = F.row_number().over(w) == 1
    marked = frames.withColumn("_cut", (F.coalesce(cover, F.lit(False)) & ~first).cast("int"))
    marked = marked.withColumn("group", F.sum("_cut").over(w) + 1)
    return marked.withColumn("single", F.sum("_cut").over(Window.partitionBy(session)) == 0).drop("_cut")


def preferred(df: DataFrame, key: str | list[str], preference: list[Column]) -> DataFrame:
    """One row a key, the first by preference."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*preference))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, ident: str | list[str], order: list) -> DataFrame:
    return preferred(df, ident, [F.col(o) if isinstance(o, str) else o for o in order])


def appended(pages: DataFrame, key: str, start: str, order: list[Column]) -> DataFrame:
    """New pages numbered start + 1, start + 2, ... in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return pages.withColumn("page_number", F.col(start) + rank)


def tripped(calls: DataFrame, key: str, order: str, outcome: str, limit: int = 5) -> DataFrame:
    """(key, at): the first call at which ``limit`` failures stand in a row.

    outcome is ok, fail, or anything else for rows that neither count nor reset.
    """
    rows = calls.where(F.col(outcome).isin("ok", "fail"))
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_island", F.sum((F.col(outcome) == "ok").cast("int")).over(w))
    fails = rows.where(F.col(outcome) == "fail")
    nth = F.row_number().over(Window.partitionBy(key, "_island").orderBy(order))
    return fails.withColumn("_n", nth).where(F.col("_n") == limit).groupBy(key).agg(F.min(order).alias("at"))


def _as_of(rows: DataFrame, points: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """rows with the largest ``value`` of the points of their key that stand before their ``at`` (0 if none); values rise with ``at``.

    Rows and points meet in pieces of ``PIECE`` places; of the pieces before only the largest value is carried on."""
    piece = F.floor(F.col(at) / PIECE)
    rows, points = rows.withColumn("_piece", piece), points.select(key, at, value).withColumn("_piece", piece)
    pieces = rows.select(key, "_piece").distinct().join(points.groupBy(key, "_piece").agg(F.max(value).alias("_most")), [key, "_piece"], "full")
    so_far = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(key, "_piece", F.coalesce(F.max("_most").over(so_far), F.lit(0)).alias("_carry"))
    marks = points.select(key, "_piece", at, F.col(value).alias("_point"))
    both = rows.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    # a point at a row's own place comes after it
    before = Window.partitionBy(key, "_piece").orderBy(at, F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_most", F.max("_point").over(before)).where("_row").drop("_row", "_point")
    return both.join(pieces, [key, "_piece"]).withColumn(name, F.greatest(F.coalesce("_most", F.lit(0)), "_carry")).drop("_most", "_carry", "_piece")


def _ranked(rows: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """rows with their rank by place within their key, in pieces of ``PIECE`` places."""
    rows = rows.withColumn("_piece", F.floor(F.col(place) / PIECE))
    counts = rows.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_piece", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(place))
    return rows.withColumn("_inside", inside).join(counts, [key, "_piece"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_piece", "_inside", "_before")


def _claims(part: pd.DataFrame) -> pd.DataFrame:
    """Which of a stem's ids that two titles could take go to which: rows (base, parent, n, before, taken, exists).

    ``base`` is the id of a title of its own and number n of its parent.  ``before``: titles of the parent before the first of
    base; ``taken``: existing ids among the parent's numbers below n; ``exists``: the id is taken in any case."""
    out, lost, won = [], set(), {}
    # parents first, and of one parent's numbers the lower first
    for r in sorted(part.itertuples(), key=lambda r: (r.base.count("_("), r.parent, r.n)):
        blocked = r.taken + (r.parent in lost) + won.get(r.parent, 0)
        if r.exists:
            continue
        if r.n - blocked <= r.before:  # the parent's titles came to this number first
            lost.add(r.base)
            out.append((r.base, 1))
        else:
            won[r.parent] = won.get(r.parent, 0) + 1
            out.append((r.parent, r.n))
    return pd.DataFrame(out, columns=["base", "n"])


def unique_titles(titles: DataFrame, title: str, position: str, existing: DataFrame, ident: str) -> DataFrame:
    """(position, title, id): ids that collide get " (2)", " (3)", ... in order of position.

    A blank title is "Untitled book n", n being its place among all titles of the batch.

    Titles of one id are ranked, and the k-th gets the k-th number that is free: k and as many as there are taken numbers
    in front of it, which is looked up among the gaps of the taken ones.  Taken are existing ids, and ids that another title
    has by itself ("Cat (2)" takes the second of "Cat").  Such an id goes to who comes first: its parent's titles have passed it by
    then, or not.  That is settled for the distinct ids in question, a stem's in one task; copies are only ranked and counted.
    """
    rows = numbered(titles.select(F.col(position).alias("position"), F.trim(F.coalesce(title, F.lit(""))).alias("_t")), [F.col("position")], "place")
    untitled = F.concat(F.lit("Untitled book "), F.col("place").cast("string"))
    rows = rows.select("position", "place", F.when(F.col("_t") == "", untitled).otherwise(F.col("_t")).alias("t"))
    rows = _ranked(rows.withColumn("base", F.translate(F.lower("t"), " ", "_")), "base", "place", "k")
    path = shared_path(titles.sparkSession, "titles")
    rows.write.parquet(path)
    rows = titles.sparkSession.read.schema(rows.schema).parquet(path)

    form = r"(?s)^(.*)_\(([1-9][0-9]{0,17})\)$"
    numbered_id = lambda c: F.when(F.regexp_extract(c, form, 2) != "", F.regexp_extract(c, form, 2)).cast("long")
    bases = rows.groupBy("base").agg(F.min("place").alias("first"))
    known = bases.select(F.col("base").alias("parent"))
    children = bases.withColumns({"parent": F.regexp_extract("base", form, 1), "n": numbered_id("base")}).where("n >= 2").join(known, "parent")
    have = existing.select(F.col(ident).alias("base")).where("base is not null").distinct()
    own = have.join(bases.select("base"), "base").select("base", F.lit(1).cast("long").alias("n"))
    of_parent = have.select(F.regexp_extract("base", form, 1).alias("parent"), numbered_id("base").alias("n")).where("n >= 2").join(known, "parent")
    taken = own.unionByName(of_parent.select(F.col("parent").alias("base"), "n"))

    # the distinct ids that a title has by itself and another as a number
    asked = _as_of(children.select("base", "parent", "n", F.col("first").alias("place")), rows.select(F.col("base").alias("parent"), "place", "k"), "parent", "place", "k", "before")
    ranks = taken.withColumn("j", F.row_number().over(Window.partitionBy("base").orderBy("n")).cast("long"))
    asked = _as_of(asked, ranks.withColumnRenamed("base", "parent"), "parent", "n", "j", "taken")
    asked = asked.join(have.withColumn("exists", F.lit(True)), "base", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    stem = F.regexp_replace("base", r"(_\([0-9]+\))+$", "")
    settled = asked.withColumn("stem", stem).groupBy("stem").applyInPandas(_claims, "base string, n long")

    ranks = taken.unionByName(settled).distinct().withColumn("j", F.row_number().over(Window.partitionBy("base").orderBy("n")).cast("long"))
    # taken number n is the j-th: who ranks above n - j steps over it
    gaps = ranks.groupBy("base", (F.col("n") - F.col("j")).alias("k")).agg(F.max("j").alias("over"))
    out = _as_of(rows, gaps, "base", "k", "over", "over").withColumn("n", F.col("k") + F.col("over"))
    mark = lambda head: F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit(f"{head}("), F.col("n").cast("string"), F.lit(")")))
    return out.select(F.col("position").cast("long").alias("position"), F.concat("t", mark(" ")).alias("title"), F.concat("base", mark("_")).alias("id"))


def cluster_sample(df: DataFrame, cluster: str, item: str, k: int, m: int, seed: int, order) -> DataFrame:
    """k clusters, then m items of each, by ``order`` (a function of column and seed giving a hashed order)."""
    chosen = df.select(cluster).distinct().orderBy(order(F.col(cluster), seed), cluster).limit(k)
    inside = df.join(chosen, cluster)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(order(F.col(item), seed), item))
    return inside.withColumn("_rank", rank).where(F.col("_rank") <= m).drop("_rank")


def simple_sample(df: DataFrame, ident: str, eligible: Column, n: int, seed: int, order) -> DataFrame:
    return df.where(eligible).orderBy(order(F.col(ident), seed), ident).limit(n)


def hashed_order(c: Column, seed: int) -> Column:
    """An order that anyone can repeat: MD5 of seed and value."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))
