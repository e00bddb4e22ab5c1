"""Table maintenance: every operator returns the new snapshot or a plan frame, and writes nothing but rows read twice to the shared folder.

Writers apply a plan by replacing the snapshot, or with MERGE where the table format has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.shared import written

PROTECTED = ("users", "edit_log", "extraction_errors", "collections")
MOST_PAGES = 449


def upsert(target: DataFrame, changes: DataFrame, key: str, provided: list[str]) -> DataFrame:
    """New snapshot: provided fields overwrite (nulls too), others are kept, new ids are added."""
    new = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in provided], F.lit(True).alias("_changed"))
    both = target.withColumn("_old", F.lit(True)).join(new, key, "full")
    pick = [F.when(F.col("_changed"), F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) if f in provided else F.col(f) for f in target.columns]
    return both.select(*pick)


def insert_absent(target: DataFrame, rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows that exist): the first row of an id in ``order`` counts."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("_place", place).where("_place = 1").drop("_place")
    known = target.select(key)
    return rows.join(known, key, "left_anti"), rows.join(known, key, "left_semi")


def audit_rows(before: DataFrame, after: DataFrame, key: str, fields: list[str], entity: str) -> DataFrame:
    """One row a changed field, values as JSON scalars, so that true, 1 and "1" stay apart."""
    as_json = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)
    old = before.select(key, *[as_json(f).alias(f"o_{f}") for f in fields])
    new = after.select(key, *[as_json(f).alias(f"n_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])
    out = old.join(new, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))).alias("p"))
    return out.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), "p.*")


def rename_plan(renames: DataFrame, books: DataFrame) -> DataFrame:
    """(old, new, refused): a rename is refused if ids are equal, the source is missing or the target exists."""
    ids = books.select(F.col("id").alias("old"), F.lit(True).alias("_src"))
    out = renames.join(ids, "old", "left").join(books.select(F.col("id").alias("new"), F.lit(True).alias("_dst")), "new", "left")
    refused = F.when(F.col("old") == F.col("new"), "same id").when(F.col("_src").isNull(), "source missing").when(F.col("_dst"), "target exists")
    return out.select("old", "new", refused.alias("refused"))


def rename_children(children: DataFrame, ident: str, book: str, plan: DataFrame) -> DataFrame:
    """Children of renamed books with a new id prefix and book reference."""
    good = plan.where(F.col("refused").isNull()).select(F.col("old").alias(book), "new")
    out = children.join(good, book, "left")
    prefix = F.concat(F.col(book), F.lit("_"))
    moved = F.concat("new", F.substring(F.col(ident), F.char_length(book) + 1, F.char_length(ident)))
    fixed = F.when(F.col("new").isNotNull() & F.startswith(F.col(ident), prefix), moved).otherwise(F.col(ident))
    keep = [c for c in children.columns if c not in (ident, book)]
    return out.select(fixed.alias(ident), F.coalesce("new", book).alias(book), *keep)


def rename_books(books: DataFrame, characters: DataFrame, titles: DataFrame, plan: DataFrame) -> DataFrame:
    """Books after a rename plan: new id, title and folder, and the list of characters built again from the table.

    books: id, title, photos_url, characters (array of ids) and others; characters: id, book; titles: id, title of the
    renamed ones.  The list of a renamed book holds the new ids of all its characters, in order of id."""
    good = plan.where(F.col("refused").isNull()).select(F.col("old").alias("id"), "new")
    # by the old book: the new id may be that of characters without a book, which are none of its own
    mine = rename_children(characters.withColumn("_old", F.col("book")), "id", "book", plan)
    people = mine.groupBy(F.col("_old").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("_list"))
    out = books.join(good, "id", "left").join(titles.select("id", F.col("title").alias("_title")), "id", "left")
    out = out.join(people, "id", "left")
    moved = F.col("new").isNotNull()
    folder = F.concat(F.regexp_extract("photos_url", "^(.*/)?", 1), F.col("_title"))
    new = {
        "id": F.coalesce("new", "id"),
        "title": F.when(moved, F.col("_title")).otherwise(F.col("title")),
        "photos_url": F.when(moved, folder).otherwise(F.col("photos_url")),
        "characters": F.when(moved, F.coalesce("_list", F.array().cast("array<string>"))).otherwise(F.col("characters")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in books.columns])


def rename_references(children: DataFrame, ref: str, book: str, plan: DataFrame) -> DataFrame:
    """Children with the id in ``ref`` carried over to the new book where it begins with a renamed book's id; book: the old one."""
    good = plan.where(F.col("refused").isNull()).select(F.col("old").alias(book), "new")
    out = children.join(good, book, "left")
    moved = F.concat("new", F.substring(F.col(ref), F.char_length(book) + 1, F.char_length(ref)))
    mine = F.col("new").isNotNull() & F.startswith(F.col(ref), F.concat(F.col(book), F.lit("_")))
    return out.withColumn(ref, F.when(mine, moved).otherwise(F.col(ref))).select(*children.columns)


def rename_characters(
    characters: DataFrame, names: DataFrame, aliases: DataFrame, books: DataFrame | None = None
) -> tuple[DataFrame, ...]:
    """(characters, aliases) after renames (id, new_name); a change of case or spaces alone keeps the id,
    a name whose id is taken is refused and changes nothing.

    characters: id, book, name; aliases: id, character.  With books (id, characters: array of ids) these follow as a third
    table: a renamed id leaves the list and the new one joins its end, in order of the old ids.
    """
    fresh = F.concat_ws("_", "book", F.lower(F.translate("new_name", " ", "_")))
    asked = characters.join(names, "id").select("id", fresh.alias("new_id"), "new_name")
    taken = characters.select(F.col("id").alias("new_id"), F.lit(True).alias("_taken"))
    plan = asked.join(taken, "new_id", "left").where(F.col("_taken").isNull() | (F.col("id") == F.col("new_id")))
    plan = plan.withColumn("_n", F.row_number().over(Window.partitionBy("new_id").orderBy("id"))).where("_n = 1").drop("_taken", "_n")
    out = characters.join(plan, "id", "left").select(F.coalesce("new_id", "id").alias("id"), "book", F.coalesce("new_name", "name").alias("name"))
    moved = aliases.join(plan.select(F.col("id").alias("character"), "new_id"), "character", "left")
    moved = moved.select(F.col("id"), F.coalesce("new_id", "character").alias("character"))
    if books is None:
        return out, moved
    swaps = plan.where("id != new_id").join(characters.select("id", "book"), "id").groupBy(F.col("book").alias("id"))
    swaps = swaps.agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("old"), F.col("new_id").alias("new")))).alias("_s"))
    lists = books.join(swaps, "id", "left")
    left = F.array_except("characters", F.transform("_s", lambda x: x["old"]))
    swapped = F.concat(left, F.transform("_s", lambda x: x["new"]))
    return out, moved, lists.withColumn("characters", F.coalesce(swapped, "characters")).drop("_s")


def delete_plan(books: DataFrame, pages: DataFrame, characters: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, path) of all that goes with the given books (book): pages, characters, aliases found by
    book or by character, files; each once.

    The books, and their characters, are written first: by their size Spark sees where they can be broadcast, and then
    the child tables, of which few rows go, are not shuffled."""
    books = written(books.select("book").distinct(), "deleted-books")
    own = lambda df: df.join(books, "book", "left_semi").select("id")
    listed = lambda df, coll: df.select(F.lit(coll).alias("collection"), F.col("id").alias("path"))
    people = written(own(characters), "deleted-characters")
    named = aliases.join(people.select(F.col("id").alias("character")), "character", "left_semi").select("id")
    parts = [listed(books.withColumnRenamed("book", "id"), "books"), listed(own(pages), "pages"), listed(people, "characters")]
    parts += [listed(own(aliases), "aliases"), listed(named, "aliases"), listed(own(files), "files")]
    return reduce(DataFrame.unionByName, parts).distinct()


def deletable_people(people: DataFrame, ident: str, books: DataFrame, refs: list[str]) -> DataFrame:
    """(id, uses, deleted): a person goes only if no book refers to it."""
    used = reduce(DataFrame.unionByName, [books.select(F.col(r).alias(ident)) for r in refs])
    uses = used.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count("*").alias("uses"))
    out = people.select(ident).join(uses, ident, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return out.withColumn("deleted", F.col("uses") == 0)


def protected(collection) -> Column:
    return F.col(collection).isin(*PROTECTED)


def moved_position(page: Column, n: Column, source: Column, target: Column) -> Column:
    """Where a page is after one page moved from source to target; others between shift by one."""
    between = F.when((page > source) & (page <= target), page - 1).when((page < source) & (page >= target), page + 1)
    return F.when(page == source, target).otherwise(F.coalesce(between, page))


def reordered(pages: DataFrame, book: str, page: str, moves: DataFrame) -> DataFrame:
    """Pages with ``new_page``; moves: book, n, source, target.  A book is left alone (``refused``) if it has over
    MOST_PAGES pages, a page of 1..n is missing or repeated, or the move leaves the range."""
    # one sort of the pages, which the join takes over: page k in place k, for every k, is 1..n without holes or repeats
    placed = pages.withColumn("_place", F.row_number().over(Window.partitionBy(book).orderBy(page)))
    each = Window.partitionBy(book)
    placed = placed.withColumns({"_k": F.count("*").over(each), "_all": F.bool_and(F.coalesce(F.col(page) == F.col("_place"), F.lit(False))).over(each)})
    out = placed.join(moves.select(book, "n", "source", "target"), book)
    n = F.col("n")
    whole = F.col("_all") & (F.col("_k") == n) & (n <= MOST_PAGES)
    good = whole & F.col("source").between(1, n) & F.col("target").between(1, n)
    new = F.when(good, moved_position(F.col(page), n, F.col("source"), F.col("target"))).otherwise(F.col(page))
    return out.withColumns({"new_page": new, "refused": ~good}).drop("n", "source", "target", "_place", "_k", "_all")


def file_moves(inventory: DataFrame, mapping: DataFrame, variants: list[str]) -> DataFrame:
    """(folder, action, old, new): moves of every variant of a moved page, and deletions of variants at the
    destination that the moving page lacks.

    inventory: folder, page, variant; mapping: folder, old, new."""
    name = lambda p, v: F.concat(F.lit("page_"), F.col(p).cast("string"), F.col(v), F.lit(".jpg"))
    grid = mapping.where("old != new").withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    at = lambda p, flag: inventory.select("folder", F.col("page").alias(p), "variant", F.lit(True).alias(flag)).distinct()
    grid = grid.join(at("old", "_from"), ["folder", "old", "variant"], "left").join(at("new", "_to"), ["folder", "new", "variant"], "left")
    action = F.when(F.col("_from"), "move").when(F.col("_to"), "delete")
    out = grid.withColumn("action", action).where(F.col("action").isNotNull())
    return out.select("folder", "action", F.when(F.col("_from"), name("old", "variant")).alias("old"), name("new", "variant").alias("new"))


def pending_writes(staged: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """(key, action): a staged write whose token was committed is finished, another is discarded; a commit
    without anything staged is cleared."""
    both = staged.select(key, F.col("token").alias("_s")).join(committed.select(key, F.col("token").alias("_c")), key, "full")
    action = F.when(F.col("_s").isNull(), "clear").when(F.col("_s").eqNullSafe(F.col("_c")), "finish").otherwise("discard")
    return both.select(key, action.alias("action"))


def clean_suggestions(suggestions: DataFrame, book: str, genders, default_gender: str) -> DataFrame:
    """Suggested characters without nameless ones; gender from the vocabulary, flags defaulted, aliases trimmed,
    articles off, once each whatever their case, without the own name.

    suggestions: book, pos, name, gender, human, plural, protagonist, aliases (array)."""
    from folio.functions.columns import in_vocabulary, without_article

    rows = suggestions.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("name", F.trim("name"))
    rows = rows.withColumns(
        {
            "gender": in_vocabulary("gender", genders, default_gender),
            "human": F.coalesce("human", F.lit(True)),
            "plural": F.coalesce("plural", F.lit(False)),
            "protagonist": F.coalesce("protagonist", F.lit(False)),
        }
    )
    spread = rows.select(book, "pos", F.lower("name").alias("_own"), F.posexplode("aliases").alias("at", "a"))
    spread = spread.withColumn("a", without_article(F.trim("a"))).where((F.col("a") != "") & (F.lower("a") != F.col("_own")))
    first = spread.groupBy(book, "pos", F.lower("a").alias("_l")).agg(F.min(F.struct("at", "a")).alias("x"))
    lists = first.groupBy(book, "pos").agg(F.array_sort(F.collect_list("x")).alias("x"))
    lists = lists.select(book, "pos", F.transform("x", lambda x: x["a"]).alias("aliases"))
    out = rows.drop("aliases").join(lists, [book, "pos"], "left")
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def commit_characters(suggestions: DataFrame, characters: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new characters, new aliases, unresolved) from reviewed suggestions.

    suggestions: book, pos, name, action (create, skip, merge), target, aliases (array).  A merge folds the name and
    its aliases into the target, existing or created in the same batch.  characters and aliases: id, book."""
    ident = lambda b, n: F.concat_ws("_", b, F.lower(F.translate(n, " ", "_")))
    rows = suggestions.where("action != 'skip'").withColumn("id", ident(F.col("book"), F.col("name")))
    made = rows.where("action = 'create'")
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos")) == 1
    new = made.withColumn("_f", first).where("_f").join(characters.select("id"), "id", "left_anti").select("id", "book", "name")
    known = characters.select("id").unionByName(made.select("id")).distinct().withColumn("_there", F.lit(True))
    to = F.when(F.col("action") == "merge", ident(F.col("book"), F.col("target"))).otherwise(F.col("id"))
    linked = rows.withColumn("character", to).join(known.withColumnRenamed("id", "character"), "character", "left")
    unresolved = linked.where(F.col("_there").isNull()).select("book", "name", "target")
    own = F.when(F.col("action") == "merge", F.array("name")).otherwise(F.array().cast("array<string>"))
    names = linked.where("_there").select("book", "character", "pos", F.explode(F.concat(own, F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.where(F.trim("name") != "").withColumn("id", ident(F.col("book"), F.col("name")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos", "character", "name"))
    fresh = names.withColumn("_n", rank).where("_n = 1").join(aliases.select("id"), "id", "left_anti")
    return new, fresh.select("id", "book", "character", "name"), unresolved


def folder_moves(inventory: DataFrame, path: str, renames: DataFrame) -> DataFrame:
    """(old_path, new_path) of every object under a renamed folder; equal or empty folders move nothing.

    renames: old, new.  An object's folder is what stands before its last slash."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    good = renames.where((F.col("old") != F.col("new")) & (F.col("old") != "") & (F.col("new") != ""))
    out = inventory.withColumn("old", folder).join(good, "old")
    return out.select(F.col(path).alias("old_path"), F.concat("new", F.substring(F.col(path), F.char_length("old") + 1, F.char_length(path))).alias("new_path"))


def complete_pages(jobs: DataFrame, job: str, n: str, results: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): a row for every page 1..n; failed and missing ones are blank, with ``corrected`` null.

    results: job, page, ok, text, error; of several results of a page the last by text and error is not told apart, so
    give one a page."""
    grid = jobs.select(job, F.explode(F.when(F.col(n) >= 1, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>"))).alias(page))
    out = grid.join(results, [job, page], "left")
    outcome = F.when(F.col("ok"), "done").when(F.col("ok").isNotNull(), "failed").otherwise("missing")
    pages = out.select(
        job,
        page,
        outcome.alias("outcome"),
        F.when(F.col("ok"), F.coalesce("text", F.lit(""))).otherwise("").alias("text"),
        F.when(F.col("ok"), F.lit(False)).alias("corrected"),
    )
    errors = out.where(~F.col("ok") | F.col("ok").isNull()).select(job, page, F.coalesce("error", F.lit("no result")).alias("error_message"))
    return pages, errors
