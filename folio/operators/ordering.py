"""Sort orders, limits, and set operations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.names import unused
from folio.sources.shared import shared_path

#: Digits to which runs are padded: longer numbers than any counter.
DIGITS = 20
#: Numbers of a session looked at together, and numbers of a range in one array.
PIECE, STEP = 1_000_000, 10_000


def natural_key(c) -> Column:
    """Array sort key: digit runs by value, the rest as text."""
    runs = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(bare(x), DIGITS, "0")).otherwise(x))


def validation_queue(books: DataFrame, submitted_only=False, flagged_only=False, owner: str | None = None) -> DataFrame:
    """Books to validate: urgent ones first, then flagged ones, then by title; label tells the flagged pages.

    books: title, status, validated, needs_review, high_priority, n_flagged, entered_by.
    """
    out = books.where(~F.coalesce("validated", F.lit(False)))
    if submitted_only:
        out = out.where(F.col("status") == "submitted")
    if flagged_only:
        out = out.where(F.coalesce("needs_review", F.lit(False)))
    if owner is not None:
        out = out.where(F.col("entered_by") == owner)
    tail = F.when(F.col("n_flagged") > 0, F.concat(F.lit(" ("), F.col("n_flagged").cast("string"), F.lit(" flagged)"))).otherwise("")
    out = out.withColumn("label", F.concat("title", tail))
    return out.orderBy(*[F.desc(F.coalesce(c, F.lit(False))) for c in ("high_priority", "needs_review")], F.lower("title"), "title")


def review_order(high: Column, title, page) -> list[Column]:
    return [F.when(high, 0).otherwise(1), F.lower(title), F.coalesce(page, F.lit(0))]


def titled_order(title, ident) -> list[Column]:
    """Case-insensitive by title, by id where the title is blank."""
    return [F.lower(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.col(ident).cast("string"))), F.col(ident)]


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in a total order: range-partitioned sort, then counts of the ranges before.

    The driver sees one count a range, not the rows; no task orders the whole table.
    """
    mark, *names = unused([*df.columns, name], "id", *[f"o{i}" for i in range(len(order))])
    keys = dict(zip(names, order))
    ranged = df.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys])
    # written, so that counting and numbering see the same ranges (each run samples its own) and lost executors lose nothing
    ranged = ranged.sortWithinPartitions(*keys).withColumn(mark, F.monotonically_increasing_id())
    path = shared_path(df.sparkSession, "numbered")
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    part = F.shiftright(mark, 33).cast("int")
    counts = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, before = 0, []
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offsets = F.array(*[F.lit(b) for b in before]) if before else F.array(F.lit(0))
    place = F.element_at(offsets, part + 1) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn(name, place.cast("long")).drop(*keys, mark)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def own_books(books: DataFrame, owner: str, system: str) -> DataFrame:
    """The owner's and the system's books with their shelf: system, submitted or in progress (also without a status)."""
    mine = books.where(F.col("entered_by") == owner)
    theirs = books.where(F.col("entered_by") == system)
    shelf = F.when(F.col("entered_by") == system, "system").when(F.col("status") == "submitted", "submitted").otherwise("in progress")
    return mine.unionByName(theirs).withColumn("shelf", shelf)


def distinct_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.unionByName(b).dropDuplicates([key])


def missing_ranges(files: DataFrame, session: str, slot: str) -> DataFrame:
    """(session, first, last): the ranges of numbers from 1 up to the highest seen that are absent.

    A session's numbers are looked at in pieces of ``PIECE``, and the pieces' ends once more, so no task takes a whole session."""
    n = F.col(slot).cast("long")
    seen = files.where(n >= 1).select(session, n.alias("_n"), F.floor(n / PIECE).alias("_piece")).distinct()
    before = F.lag("_n").over(Window.partitionBy(session, "_piece").orderBy("_n"))
    inside = seen.select(session, (before + 1).alias("first"), (F.col("_n") - 1).alias("last"))
    ends = seen.groupBy(session, "_piece").agg(F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    before = F.coalesce(F.lag("_high").over(Window.partitionBy(session).orderBy("_piece")), F.lit(0))
    between = ends.select(session, (before + 1).alias("first"), (F.col("_low") - 1).alias("last"))
    return inside.unionByName(between).where("first <= last")


def missing_slots(files: DataFrame, session: str, slot: str) -> DataFrame:
    """(session, slot) of the numbers 1..highest seen that are absent."""
    ranges = missing_ranges(files, session, slot).withColumn("_from", F.explode(F.sequence("first", "last", F.lit(STEP))))
    # a row for each STEP numbers before a row for each
    numbers = F.sequence("_from", F.least("last", F.col("_from") + STEP - 1))
    return ranges.select(session, F.explode(numbers).alias(slot)).withColumn(slot, F.col(slot).cast("int"))


def manifest_matches(manifests: DataFrame, session: str, listed: str, files: DataFrame, name: str) -> DataFrame:
    """(session, complete): the files present are exactly those listed; an empty or absent list never matches."""
    have = files.groupBy(session).agg(F.array_sort(F.collect_set(name)).alias("_have"))
    want = F.array_sort(F.array_distinct(listed))
    out = manifests.join(have, session, "left")
    return out.select(session, F.coalesce((F.size(want) > 0) & (want == F.col("_have")), F.lit(False)).alias("complete"))
