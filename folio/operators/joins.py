"""Joins: lookups, reconciliation, referential audits, name matching, nesting.

Sizes are left to Spark: it broadcasts a side whose measured size is under its threshold and
shuffles otherwise; none of these operators forces a broadcast.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import NON_BOOK_FOLDERS
from folio.functions.matching import ratios
from folio.sources.shared import Folder, shared_path
from folio.sources.snapshots import Store


def lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row for each requested id; a missing one has nulls and exists = false."""
    found = table.withColumn("exists", F.lit(True))
    return ids.join(found, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def lookup_in_order(requests: DataFrame, refs: str, table: DataFrame, key: str) -> DataFrame:
    """Rows of a list of references with their position; order and duplicates are kept."""
    others = [c for c in requests.columns if c != refs]
    return requests.select(*others, F.posexplode(refs).alias("pos", key)).join(table, key, "left")


def existing(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return ids.join(table.select(key), key, "left_semi")


def reconcile(base: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """base with the columns of every source matched on a normal form; has_<source> tells a match."""
    return reduce(
        lambda df, kv: df.join(kv[1].withColumn(f"has_{kv[0]}", F.lit(True)), key, "left").withColumn(
            f"has_{kv[0]}", F.coalesce(f"has_{kv[0]}", F.lit(False))
        ),
        sources.items(),
        base,
    )


def coverage(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Which keys are in which sources: one grouped pass over the union, no chain of full joins."""
    tagged = [df.select(F.col(key), F.lit(name).alias("_in")).where(F.col(key).isNotNull()) for name, df in sources.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(key).agg(*[F.max(F.col("_in") == name).alias(f"in_{name}") for name in sources])


def dangling(child: DataFrame, child_id: str, ref: str, parent: DataFrame, parent_id: str, collection: str) -> DataFrame:
    """Child rows whose reference 'collection/id' is null, of another collection, or without target."""
    parts = F.split(F.col(ref), "/", 2)
    keyed = child.select(child_id, ref, F.get(parts, F.lit(0)).alias("_coll"), F.get(parts, F.lit(1)).alias("_key"))
    known = parent.select(F.col(parent_id).cast("string").alias("_key"), F.lit(True).alias("_there")).distinct()
    reason = (
        F.when(F.col(ref).isNull(), "no reference")
        .when(F.col("_coll") != collection, "wrong collection")
        .when(F.col("_there").isNull(), "missing target")
    )
    return keyed.join(known, "_key", "left").select(child_id, ref, reason.alias("reason")).where(F.col("reason").isNotNull())


def orphan_folders(objects: DataFrame, books: DataFrame, folder: str, book_folder: str, least: int = 1) -> DataFrame:
    """Folders with page images that belong to no book; ``objects`` has folder and is_page."""
    counts = objects.where(~F.col(folder).isin(*NON_BOOK_FOLDERS)).groupBy(folder).agg(F.count_if("is_page").alias("n_pages"))
    keys = books.select(F.col(book_folder).alias(folder)).distinct()
    return counts.where(F.col("n_pages") >= least).join(keys, folder, "left_anti")


def _ratio(cutoff: float | None = None):
    """The matching-blocks ratio as a column function; 0 for pairs below a cutoff."""

    def of(option: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series(ratios(option.tolist(), name.tolist(), cutoff), dtype="float64")

    return F.pandas_udf(of, "double")


#: Letters of a name up to which options that are a letter off are found by leaving out each letter in turn.
SHORT = 256


def one_letter_off(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Pairs (a, b) of equal strings and of strings of which one is the other with a letter more, of up to SHORT letters; equal hashes
    bring in others now and then."""
    fewer = lambda c: F.transform(
        F.sequence(F.lit(1), F.char_length(c)), lambda i: F.xxhash64(F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    )
    whole = lambda df, c: df.select(c, F.xxhash64(c).alias("_h"))
    short = lambda df, c: df.where(F.char_length(c).between(1, SHORT)).select(c, F.explode(F.array_distinct(fewer(F.col(c)))).alias("_h"))
    sides = [(whole(left, a), whole(right, b)), (whole(left, a), short(right, b)), (short(left, a), whole(right, b))]
    return reduce(DataFrame.unionByName, [x.join(y, "_h").select(a, b) for x, y in sides]).distinct()


def fuzzy_match(names: DataFrame, name: str, options: DataFrame, option: str, cutoff: float = 0.8) -> DataFrame:
    """(name, match, score): the option of the best matching-blocks ratio, ties to the largest; null if none.

    ``cutoff`` is 0.8 at least, which the blocking below relies on; lower ones are an error.

    Each distinct name is matched once.  Options are blocked by length (a ratio of ``cutoff`` needs
    2 min / (min + max) of it) and by pairs of neighbouring letters: M matching letters in blocks with at most la + lb - 2 M
    gaps share 3 M - la - lb - 1 of them, which is s or more for any partner of a name, so two such names share one
    that is among the g - s + 1 rarest of each.  The common letters bound the ratio before a pair is compared, a batch of pairs at a time.

    Names of one pattern (numbered ones) are all within the cutoff of each other.  Options that are equal to a name or a letter off are
    therefore found first, by equality; only names that they do not settle are blocked.
    """
    if cutoff < 0.8:
        raise ValueError("cutoff must be 0.8 or more")
    low = lambda c: F.lower(F.trim(c))
    # lower-cased options keep their first spelling in byte order
    opts = options.where(F.col(option).isNotNull()).groupBy(F.lower(option).alias("_o")).agg(F.min(option).alias("match"))
    asked = names.where(F.trim(name) != "").select(F.col(name).alias("name"), low(F.col(name)).alias("_n")).distinct()
    letters = F.expr(
        "aggregate(array_distinct(split(_n, '')), 0, (s, x) -> s + least("
        "char_length(_n) - char_length(replace(_n, x, '')), char_length(_o) - char_length(replace(_o, x, ''))))"
    )

    def best_of(pairs: DataFrame) -> DataFrame:
        """(_n, b) of pairs (_n, _o) that reach the cutoff."""
        near = pairs.where(2 * letters >= cutoff * (F.char_length("_n") + F.char_length("_o")))
        scored = near.withColumn("score", _ratio(cutoff)("_o", "_n")).where(F.col("score") >= cutoff)
        return scored.groupBy("_n").agg(F.max(F.struct("score", "_o")).alias("b"))

    # a name's best option within one letter is its best of all, if none that is two letters off can reach its ratio
    every = asked.select("_n").distinct()
    close = best_of(one_letter_off(every, "_n", opts.select("_o"), "_o"))
    length = F.char_length("_n")
    settled = close.where(((length < SHORT) | (F.col("b.score") == 1)) & (F.col("b.score") > 2 * length / (2 * length + 2) + 1e-9))
    path = shared_path(names.sparkSession, "settled")
    settled.write.parquet(path)
    settled = names.sparkSession.read.schema(settled.schema).parquet(path)
    open_names = every.join(settled.select("_n"), "_n", "left_anti")

    # the k-th time that a pair of letters stands in a name is an element of its own
    pairs_of = lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))
    )

    def elements(df: DataFrame, name: str) -> DataFrame:
        numbered = F.transform("_p", lambda x, i: F.concat(x, F.size(F.filter(F.slice("_p", 1, i), lambda y: y == x)).cast("string")))
        return df.select(name, F.char_length(name).alias("_l"), pairs_of(F.col(name)).alias("_p")).select(name, "_l", F.explode(numbered).alias("_g"))

    mine, theirs = elements(open_names, "_n"), elements(opts.select("_o"), "_o")
    often = mine.select("_g").unionByName(theirs.select("_g")).groupBy("_g").agg(F.count("*").alias("_f"))

    def rarest(side: DataFrame, name: str) -> DataFrame:
        least = F.greatest(F.ceil((1.5 * cutoff - 1) * 2 / (2 - cutoff) * F.col("_l") - 1 - 1e-9), F.lit(1))
        place = F.row_number().over(Window.partitionBy(name).orderBy("_f", "_g"))
        few = side.join(often, "_g").withColumn("_k", place).where(F.col("_k") <= F.greatest(F.col("_l") - 1, F.lit(1)) - least + 1)
        # names of two and three letters can match without a pair in common: they meet by themselves
        short = side.where("_l <= 3").select(name, "_l", F.lit("").alias("_g")).distinct()
        return few.select(name, "_l", "_g").unionByName(short)

    left, right = rarest(mine, "_n"), rarest(theirs, "_o").withColumnRenamed("_l", "_lo")
    near = 2 * F.least("_l", "_lo") >= cutoff * (F.col("_l") + F.col("_lo"))
    pairs = left.join(right, "_g").where(near).select("_n", "_o").distinct()
    best = settled.unionByName(best_of(pairs)).select("_n", F.col("b.score").alias("score"), F.col("b._o").alias("_o"))
    return asked.join(best, "_n", "left").join(opts, "_o", "left").select("name", "match", "score")


def resolve_or_create(names: DataFrame, name: str, entities: DataFrame, entity_id: str, entity_name: str, new_id: Column) -> DataFrame:
    """(name, id, created): a fuzzy match reuses its entity, others get ``new_id`` (of column name) unless it exists."""
    matched = fuzzy_match(names, name, entities, entity_name)
    known = entities.groupBy(F.col(entity_name).alias("match")).agg(F.min(entity_id).alias("_id"))
    out = matched.join(known, "match", "left").select("name", "_id", new_id.alias("_new"))
    there = entities.select(F.col(entity_id).alias("_new"), F.lit(True).alias("_there")).distinct()
    out = out.join(there, "_new", "left")
    # one new entity an id, whichever spelling comes first
    first = F.row_number().over(Window.partitionBy("_new", F.col("_id").isNull()).orderBy("name")) == 1
    created = F.col("_id").isNull() & F.col("_there").isNull() & first
    return out.select("name", F.coalesce("_id", "_new").alias("id"), created.alias("created"))


def alias_targets(aliases: DataFrame, characters: DataFrame, keys: list[str], target: str) -> DataFrame:
    """aliases with the character they name within the book, and whether it was found."""
    side = characters.select(*keys, F.col(target).alias("target"))
    return aliases.join(side, keys, "left").withColumn("resolved", F.col("target").isNotNull())


def in_scope(facts: DataFrame, key: str, selection: DataFrame | None) -> DataFrame:
    """Facts whose key is in the selected lists (column keys: array); a selection without any item keeps all.

    Items that lead nowhere (null keys) are a selection, and keep nothing.
    """
    if selection is None:
        return facts
    keys = selection.select(F.explode("keys").alias(key))
    if keys.isEmpty():  # looks at one row
        return facts
    return facts.join(keys.distinct(), key, "left_semi")


def with_names(df: DataFrame, dimensions: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Left joins of dimension names: (dimension, key, its column in df, name of the result)."""
    for dim, key, fk, out in dimensions:
        side = dim.select(F.col(key).alias(fk), F.col(dim.columns[1]).alias(out))
        df = df.join(side, fk, "left")
    return df


def nested(parents: DataFrame, key: str, children: DataFrame, fields: list[str], out: str) -> DataFrame:
    """parents with their children as a sorted array of structs (empty if none)."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    return parents.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array()))


def page_book(df: DataFrame, ref: str, page_id: str, number: str) -> Column:
    """Book id of a page: from its reference, else its own id without the page number, else its id."""
    own = F.col(page_id)
    tail = F.concat(F.lit("_"), F.col(number).cast("string"))
    stripped = F.when(F.endswith(own, tail), F.substring(own, F.lit(1), F.char_length(own) - F.char_length(tail)))
    return F.coalesce(F.regexp_extract(F.nullif(F.col(ref), F.lit("")), "[^/]*$", 0), F.nullif(stripped, F.lit("")), F.nullif(own, F.lit("")), F.lit("(unknown book)"))


def not_known(suggestions: DataFrame, existing_: DataFrame, book: str, name: str) -> DataFrame:
    """suggestions with ``skipped`` for names the book already has, whatever their case."""
    have = existing_.select(F.col(book), F.lower(F.trim(name)).alias("_name"), F.lit(True).alias("skipped")).distinct()
    out = suggestions.withColumn("_name", F.lower(F.trim(name))).join(have, [book, "_name"], "left")
    return out.withColumn("skipped", F.coalesce("skipped", F.lit(False))).drop("_name")


def backfilled_list(parents: DataFrame, key: str, listed: str, children: DataFrame, child: str) -> DataFrame:
    """(key, list): the parent's own list without missing children, in order; its children sorted if it has none."""
    have = children.groupBy(key).agg(F.array_sort(F.collect_set(child)).alias("_have"))
    own = F.filter(listed, lambda x: F.array_contains("_have", x))
    empty = F.col(listed).isNull() | (F.size(listed) == 0)
    joined = parents.join(have, key, "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    return joined.select(key, F.when(empty, F.col("_have")).otherwise(own).alias("list"))


def missing_derivatives(objects: DataFrame) -> DataFrame:
    """(folder, page, source) of originals without a display copy; the cropped one is the source if there is one.

    objects: folder, page, variant ('' for an original)."""
    has = lambda v: F.max(F.col("variant") == v)
    pages = objects.groupBy("folder", "page").agg(has("").alias("o"), has("_display").alias("d"), has("_cropped").alias("c"))
    return pages.where(F.col("o") & ~F.col("d")).select("folder", "page", F.when(F.col("c"), "_cropped").otherwise("").alias("source"))


def by_priority(df: DataFrame, key: str, sources: list[DataFrame], fields: list[str], skip: dict[str, set[int]] | None = None) -> DataFrame:
    """Fields filled from the first source that has them; skip names sources a field does not use."""
    out = df.select(key)
    for i, s in enumerate(sources):
        out = out.join(s.select(key, *[F.col(f).alias(f"_{i}_{f}") for f in fields]), key, "left")
    use = lambda f: [i for i in range(len(sources)) if i not in (skip or {}).get(f, ())]
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return out.select(key, *[F.coalesce(*[blank(f"_{i}_{f}") for i in use(f)]).alias(f) for f in fields])


def content_key(parts: list[str]) -> Column:
    """SHA-1 of the parts as strings with a zero byte between them; null is ''."""
    blank = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha1(reduce(lambda a, b: F.concat(a, F.lit("\x00"), b), blank).cast("binary"))


def cached(requests: DataFrame, parts: list[str], cache: DataFrame, scorer, schema: str, ahead: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all results, results to append to the cache): content keys found in the cache are reused.

    cache: key and the columns of ``schema``; scorer(DataFrame of misses) gives key, the same columns and ok.
    Failures are not appended, so they are tried again next time.

    The scorer's results are written to ``ahead`` (a folder) before anything is returned, and both frames read them there, so a
    miss is scored once.  Where the folder stands complete, as a job before left it, nothing is scored again.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", content_key(parts))
    columns = [f.split()[0] for f in schema.split(",")]
    held = cache.select("key", *columns)
    ahead = ahead or shared_path(spark, "scored")
    if "_SUCCESS" not in Folder(spark, ahead).names():
        misses = keyed.join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
        scorer(misses).select("key", *columns, "ok").write.mode("overwrite").parquet(ahead)
    scored = spark.read.schema(f"key string, {schema}, ok boolean").parquet(ahead)
    hits = keyed.join(held, "key").withColumn("cached", F.lit(True))
    again = keyed.join(held.select("key"), "key", "left_anti").join(scored.select("key", *columns), "key")
    return hits.unionByName(again.withColumn("cached", F.lit(False))), scored.where("ok").select("key", *columns)


def score_once(requests: DataFrame, parts: list[str], store: Store, table: str, scorer, schema: str, writer: str, number: int) -> DataFrame:
    """Results of all requests from a store's table of results, which new ones are added to: a content key that was
    scored without failure is never scored again, whoever asks and however often a job is run.

    Results go to a folder named by writer and number before they are committed; a job that stopped in between
    finds them there."""
    spark = requests.sparkSession
    version = store.pointer()
    there = table in version["tables"]
    cache = store.read(table, version["version"]) if there else spark.createDataFrame([], f"key string, {schema}")
    folder = f"ahead-{writer}-{number}"
    if store.done(writer, number):
        # a job that is run again: what it added is in the table, and only its failures are not
        folder = f"again-{uuid.uuid4().hex}"
    out, new = cached(requests, parts, cache, scorer, schema, f"{store.path}/{folder}")
    store.write({table: new}, writer, number, append=True)
    return out


def name_dimension(table: DataFrame, name: str, ident: str, order: str) -> DataFrame:
    """name -> id; of equal names the last in ``order`` counts."""
    return table.groupBy(F.col(name).alias("name")).agg(F.max_by(ident, order).alias("id"))
