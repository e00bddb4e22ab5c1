"""Aggregations: breakdowns, rollups, word multisets, summaries, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.names import unused

#: What ``shared_words`` adds: words in common, of the left text, of the right one.
COUNTS = ("common", "left", "right")
METRICS = ("calls", "cost_usd", "input_tokens", "output_tokens", "cache_read", "cache_write")
FLAG_BELOW = 0.85


def gender_breakdown(facts: DataFrame, gender: str, human: str, genders, spark) -> DataFrame:
    """(chart, gender, n, pct) for humans, others and both, over the fixed genders, zeros shown.

    pct is of all rows in scope, those of other genders included.  One pass over the rows; the
    spine and the total are of fixed size.
    """
    counts = facts.groupBy(F.col(gender).alias("gender")).agg(
        F.count_if(F.col(human)).alias("human"), F.count_if(F.coalesce(~F.col(human), F.lit(True))).alias("non_human")
    )
    counts = counts.withColumn("combined", F.col("human") + F.col("non_human"))
    spine = spark.createDataFrame([(g,) for g in genders], "gender string")
    total = counts.agg(F.coalesce(F.sum("combined"), F.lit(0)).alias("total"))
    wide = spine.join(counts, "gender", "left").crossJoin(total)  # one row of totals
    long = wide.unpivot(["gender", "total"], ["human", "non_human", "combined"], "chart", "n")
    n = F.coalesce("n", F.lit(0))
    return long.select("chart", "gender", n.alias("n"), F.when(F.col("total") > 0, n * 100.0 / F.col("total")).otherwise(0.0).alias("pct"))


def usage_rollup(calls: DataFrame, day: str = "day") -> DataFrame:
    """Totals by day, by day and model, by day and flow: (day, level, key, metrics)."""
    sums = [F.count("*").alias("calls")] + [F.sum(m).alias(m) for m in METRICS[1:]]
    grouped = calls.groupingSets([[day], [day, "model"], [day, "flow"]], day, "model", "flow").agg(
        F.grouping("model").alias("_m"), F.grouping("flow").alias("_f"), *sums
    )
    level = F.when(F.col("_m") == 0, "model").when(F.col("_f") == 0, "flow").otherwise("total")
    key = F.when(F.col("_m") == 0, F.col("model")).when(F.col("_f") == 0, F.col("flow"))
    return grouped.select(day, level.alias("level"), key.alias("key"), *METRICS)


def usage_summary(rollup: DataFrame, today: str, days: int = 30, day: str = "day") -> DataFrame:
    """Today's totals and those of the last ``days`` days (today included), by level and key, dearest first."""
    age = F.date_diff(F.lit(today).cast("date"), F.col(day).cast("date"))
    recent = rollup.where(age.between(0, days - 1)).withColumn("_today", age == 0)
    both = recent.withColumn("span", F.explode(F.when(F.col("_today"), F.array(F.lit("today"), F.lit("recent"))).otherwise(F.array(F.lit("recent")))))
    out = both.groupBy("span", "level", "key").agg(*[F.sum(m).alias(m) for m in METRICS])
    return out.orderBy("span", "level", F.desc("cost_usd"), "key")


def cost_report(calls: DataFrame, books: str) -> DataFrame:
    """Costs by operation and model, by operation, and in total; the total also per book."""
    sums = [F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")]
    # the distinct books are counted by themselves: beside a rollup every row would be expanded for them
    one = calls.agg(F.count_distinct(books).alias("_books"))
    out = calls.rollup("operation", "model").agg(*sums, F.grouping_id().alias("_level"))
    out = out.crossJoin(one)  # one row
    level = F.when(F.col("_level") == 0, "model").when(F.col("_level") == 1, "operation").otherwise("total")
    per = F.when(F.col("_level") == 3, F.col("cost_usd") / F.col("_books"))
    return out.select(level.alias("level"), "operation", "model", "calls", "cost_usd", "input_tokens", "output_tokens", per.alias("cost_per_book"))


def shared_words(rows: DataFrame, keep: list[str], left: Column, right: Column, letters: str = "a-zA-Z0-9") -> DataFrame:
    """rows' ``keep`` columns and three more, the words that two texts of a row have in common, counted as
    multisets, and those of each (under ``COUNTS`` with marks before them that clash with no column of ``keep``).  Words are runs
    of ``letters``; both texts are in the row, so nothing is shuffled."""
    names = unused(keep, *COUNTS)
    source = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.coalesce(x, F.lit("")).alias(n) for x, n in zip((left, right), names[1:])])
    schema = T.StructType([*source.schema.fields[: len(keep)], *(T.StructField(n, T.LongType()) for n in names)])
    at_l, at_r = len(keep), len(keep) + 1

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def words(texts):
            lists = pc.split_pattern_regex(texts, f"[^{letters}]+")
            row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
            some = pc.not_equal(word, "")
            return row.filter(some).to_numpy(), word.filter(some)

        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column(at_l)), pc.binary_length(batch.column(at_r))).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                # a megabyte of text at a time, one row at least
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), side="right")))
                part, n = batch.slice(at, end - at), end - at
                (lr, lw), (rr, rw) = words(part.column(at_l)), words(part.column(at_r))
                codes = pa.concat_arrays([lw, rw]).dictionary_encode()
                width, codes = max(len(codes.dictionary), 1), codes.indices.to_numpy().astype(np.int64)
                lk, ln = np.unique(lr * width + codes[: len(lr)], return_counts=True)
                rk, rn = np.unique(rr * width + codes[len(lr) :], return_counts=True)
                both, i, j = np.intersect1d(lk, rk, assume_unique=True, return_indices=True)
                common = np.bincount(both // width, np.minimum(ln[i], rn[j]), n).astype(np.int64)
                counts = [pa.array(x) for x in (common, np.bincount(lr, minlength=n), np.bincount(rr, minlength=n))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *counts], schema.names)
                at = end

    return source.mapInArrow(count, schema)


def overlap(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, jaccard, containment) of two texts in a row: multiset overlaps of their words, lower-cased ASCII letters and digits.

    Both texts empty: similarity 1; one empty: 0; an empty reference (right) is wholly contained.
    """
    out = shared_words(pairs, keys, F.lower(left), F.lower(right), "a-z0-9")
    common, one, other = unused(keys, *COUNTS)
    every = F.col(one) + F.col(other) - F.col(common)
    return out.select(
        *keys,
        F.coalesce(F.col(common) / F.nullif(every, F.lit(0)), F.lit(1.0)).alias("jaccard"),
        F.coalesce(F.col(common) / F.nullif(other, F.lit(0)), F.lit(1.0)).alias("containment"),
    )


def only_removed(df: DataFrame, original: str, cleaned: str) -> DataFrame:
    """df with ``kept``: the cleaned text adds no word to the original (case counts) and is not blank."""
    out = shared_words(df, df.columns, F.col(original), F.col(cleaned))
    common, one, other = unused(df.columns, *COUNTS)
    blank = F.trim(F.coalesce(cleaned, F.lit(""))) == ""
    return out.withColumn("kept", ~blank & (F.col(common) == F.col(other))).drop(common, one, other)


def clean_outcome(df: DataFrame, key: str, original: str, cleaned: str, sense: str, fits: str) -> DataFrame:
    """(key, status, final_text, needs_review, priority) of a cleaning reply; a null reply (cleaned and verdicts null) failed."""
    from folio.functions.columns import review_verdict

    text, new = F.coalesce(original, F.lit("")), F.trim(F.coalesce(cleaned, F.lit("")))
    status = (
        F.when(F.col(sense).isNull() & F.col(cleaned).isNull(), "failed")
        .when((new == "") | (new == text), "unchanged")
        .when(F.col("kept"), "cleaned")
        .otherwise("rejected")
    )
    out = only_removed(df, original, cleaned).withColumn("status", status)
    out = out.withColumn("final_text", F.when(F.col("status") == "cleaned", new).otherwise(text))
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    out = out.withColumn("_v", review_verdict(yes(sense), yes(fits), F.trim("final_text") != ""))
    failed, rejected = F.col("status") == "failed", F.col("status") == "rejected"
    priority = F.when(failed, "normal").when(rejected & (F.col("_v.priority") != "high"), "normal").otherwise(F.col("_v.priority"))
    return out.select(key, "status", "final_text", (failed | rejected | F.col("_v.needs_review")).alias("needs_review"), priority.alias("priority"))


def ordered_text(pages: DataFrame, key: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, text): the non-empty texts of a key in order."""
    some = pages.where(F.coalesce(text, F.lit("")) != "")
    parts = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(key, F.array_join(F.transform("p", lambda p: p[text]), separator).alias("text"))


def cross_check(scores: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: mean containment and similarity, how many lie below the mark, how many have no reference."""
    none = expected.join(scores, key, "left_anti").agg(F.count("*").alias("no_reference"))
    means = scores.agg(
        F.avg("containment").alias("containment"), F.avg("jaccard").alias("jaccard"), F.count_if(F.col("containment") < FLAG_BELOW).alias("below")
    )
    return means.crossJoin(none)  # one row by one row


def review_flags(pages: DataFrame, key: str, page: str, flagged: str, high: str, reasons: dict[str, Column]) -> DataFrame:
    """(key, needs_review, pages, high, note): flags of a book from its pages; reasons are conditions on the grouped rows."""
    g = pages.groupBy(key).agg(
        F.bool_or(flagged).alias("needs_review"),
        F.array_sort(F.collect_set(F.when(F.col(flagged), F.col(page)))).alias("pages"),
        F.bool_or(F.col(flagged) & F.col(high)).alias("high"),
        *[c.alias(f"_r{i}") for i, c in enumerate(reasons.values())],
    )
    note = F.concat_ws("; ", *[F.when(F.col(f"_r{i}"), F.lit(name)) for i, name in enumerate(reasons)])
    return g.select(key, (F.col("needs_review") | (note != "")).alias("needs_review"), "pages", "high", note.alias("note"))


def corpus_totals(books: DataFrame, pages: DataFrame, characters: DataFrame, aliases: DataFrame, existing: dict[str, DataFrame]) -> DataFrame:
    """One row of an import's totals.

    books: skipped, referenced (booleans), author, illustrator, publisher; pages: book, story, image, layer, ocr, skipped,
    cleaned, rejected, flagged, high, ocr_failed, judge_failed (booleans); existing: name of a people column to a table
    with ``id``: shared records that are there before the import.  Every table is aggregated by itself to one row."""
    new = ~F.col("skipped")
    people = ("author", "illustrator", "publisher")
    parts = [
        books.agg(
            F.count_if(new).alias("books"),
            F.count_if(F.col("skipped")).alias("books_skipped"),
            F.count_if(new & ~F.col("referenced")).alias("no_reference"),
        ),
        # each by itself: several distinct counts in one aggregation would make a row of every row for each
        *[books.where(new & F.col(p).isNotNull()).select(p).distinct().agg(F.count("*").alias(f"{p}s")) for p in people],
        pages.agg(
            F.count("*").alias("pages"),
            F.count_if("story").alias("story_pages"),
            F.count_if("image").alias("images"),
            F.count_if("layer").alias("pages_text_layer"),
            F.count_if("ocr").alias("pages_needing_ocr"),
            F.count_if("skipped").alias("pages_skipped_ocr"),
            F.count_if("cleaned").alias("pages_cleaned"),
            F.count_if("rejected").alias("pages_clean_rejected"),
            F.count_if("flagged").alias("pages_flagged"),
            F.count_if(F.col("flagged") & F.col("high")).alias("pages_flagged_high"),
            F.count_if("ocr_failed").alias("ocr_failed"),
            F.count_if("judge_failed").alias("judge_failed"),
        ),
        pages.where(F.col("flagged") & F.col("book").isNotNull()).select("book").distinct().agg(F.count("*").alias("books_flagged")),
        characters.agg(F.count("*").alias("characters")),
        aliases.agg(F.count("*").alias("aliases")),
    ]
    for p in people:
        held = books.where(new & F.col(p).isNotNull()).select(F.col(p).alias("id")).distinct().join(existing[p], "id", "left_semi")
        parts.append(held.agg(F.count("*").alias(f"{p}s_existing")))
    return reduce(DataFrame.crossJoin, parts)  # of one row each


def image_counts(books: DataFrame, key: str, images: DataFrame, threshold: int = 2) -> DataFrame:
    """(key, n, reason): books with few page images; those without any count 0."""
    n = images.groupBy(key).agg(F.count("*").alias("n"))
    out = books.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    noun = F.when(F.col("n") == 1, "image").otherwise("images")
    reason = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" page "), noun)
    return out.select(key, "n", F.when(F.col("n") <= threshold, reason).alias("reason"))


def last_page(books: DataFrame, key: str, declared: str, pages: DataFrame, number: str) -> DataFrame:
    """(key, highest, append_at): the highest page whatever holes there are, and where new pages start."""
    top = pages.groupBy(key).agg(F.max(number).alias("highest"))
    out = books.select(key, declared).join(top, key, "left").withColumn("highest", F.coalesce("highest", F.lit(0)))
    return out.select(key, "highest", F.greatest("highest", F.coalesce(declared, F.lit(0))).alias("append_at"))


def duplicate_names(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(items: DataFrame, key: str, order: str, body: str, head: int = 65536) -> DataFrame:
    """(key, fingerprint): MD5 of the number of items and the heads of the first and the last."""
    g = items.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min_by(F.substring(F.coalesce(body, F.lit("")), 1, head), order).alias("a"),
        F.max_by(F.substring(F.coalesce(body, F.lit("")), 1, head), order).alias("z"),
    )
    return g.select(key, F.md5(F.concat(F.col("n").cast("string"), "a", "z").cast("binary")).alias("fingerprint"))


def accuracy(rows: DataFrame, item: str, correct: str, categories: list[str]) -> DataFrame:
    """(category, correct, total, pct): every row scores under ALL and under each of its categories."""
    cats = F.array(F.lit("ALL"), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categories])
    g = rows.select(item, F.explode(cats).alias("category"), F.col(correct).alias("_ok")).groupBy("category")
    g = g.agg(F.count_if("_ok").alias("correct"), F.count("*").alias("total"))
    return g.withColumn("pct", F.col("correct") * 100.0 / F.col("total"))


def flips(rows: DataFrame, item: str, predicted: str) -> DataFrame:
    """Items whose prediction is not the same in all runs."""
    return rows.groupBy(item).agg(F.count_distinct(predicted).alias("n")).where("n > 1").select(item)


def rotation_grid(items: DataFrame, item: str, predictions: DataFrame, spread: str) -> DataFrame:
    """Items under four turns with what is wanted and whether the prediction has it.

    A turn by d wants (360 - d) mod 360; a quarter turn swaps the expectation of the fold.
    """
    grid = items.select(item, spread, F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)])).alias("angle"))
    grid = grid.withColumn("want", F.pmod(360 - F.col("angle"), F.lit(360)))
    grid = grid.withColumn("want_spread", F.when(F.col("angle") % 180 != 0, ~F.col(spread)).otherwise(F.col(spread)))
    out = grid.join(predictions, [item, "angle"], "left")
    return out.withColumn("ok", F.coalesce(F.col("predicted") == F.col("want"), F.lit(False)))


def joint_error(rows: DataFrame, item: str, bad_a: Column, bad_b: Column) -> DataFrame:
    """One row: the most errors that two judges can share, summed over items."""
    g = rows.groupBy(item).agg(F.count_if(bad_a).alias("a"), F.count_if(bad_b).alias("b"))
    return g.agg(F.sum(F.least("a", "b")).alias("worst"), F.sum("a").alias("bad_a"), F.sum("b").alias("bad_b"))


def complete_jobs(jobs: DataFrame, job: str, n: str, pages: DataFrame, page: str, terminal: Column) -> DataFrame:
    """(job, complete): every page 1..n has a terminal result; a job without pages is complete."""
    inside = pages.where(terminal).join(jobs.select(job, n), job).where(F.col(page).between(1, F.col(n)))
    done = inside.groupBy(job).agg(F.count_distinct(page).alias("_n"))
    out = jobs.select(job, n).join(done, job, "left")
    return out.select(job, (F.coalesce("_n", F.lit(0)) == F.col(n)).alias("complete"))


def first_text(pages: DataFrame, key: str, order: str, text: str, kind: Column) -> DataFrame:
    """(key, text): the text of the lowest page of a kind that has any."""
    return pages.where(kind & (F.coalesce(text, F.lit("")) != "")).groupBy(key).agg(F.min_by(text, order).alias("text"))
