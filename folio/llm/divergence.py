"""Source divergence audit: how far the sources of a language differ in the terms they use, and in which.

Each language gets a ``CountVectorizer`` with ``minDF`` and the largest integer as ``vocabSize``, so its vocabulary is
exactly the terms that ``min_df`` of its documents hold.  The sparse vectors of its documents are summed by
source, index by index, with whole numbers.  These sparse sums feed the evaluation of pairs: terms are dealt to blocks,
and a block of terms by a tile of sources makes partial sums of |p - q| for the pairs of the tile, where a source
without a term has the value of a count of 0; a pair's partial sums are added up.  Memory of a task is bounded by
``BLOCK`` terms times two tiles of ``TILE`` sources.

p = 1 + floor(10**9 (count + 5) / (N + 5 V)) in whole numbers (decimals of 38 digits where they are multiplied).

Languages are taken one after another.  The driver and each task hold one vocabulary at a time, as ``CountVectorizer`` does:
the terms of one language that ``min_df`` documents hold, in ``parts`` parts; the terms are dealt to parts by
their hash, each part has a vectorizer of its own, and the result is the same for any number.

Defined results: null text, lang and source are ''; a group without terms has the value of count 0 everywhere; a language
without kept terms has pairs of value 0 and no terms; a source alone in its language has no pairs; repeated rows count
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, keep, new_path
from .words import raw, slices

MIN_DF, TOP = 30, 50
#: The largest integer: no term that min_df documents hold is left out.
MOST = 2**31 - 1
#: Terms of a block and sources of a tile.
BLOCK, TILE = 4096, 256

#: A term's bytes in lower case, a space for all others.
_TERM = np.full(256, 32, np.uint8)
for _first, _last, _add in ((0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _TERM[_first : _last + 1] = np.arange(_first, _last + 1) + _add


def spaced(column: pa.Array) -> pa.Array:
    """Each text as its terms, A-Z in lower case, with one space between them."""
    data, offsets = raw(column)
    data = _TERM[data]
    inside = data != 32
    stays = inside.copy()
    stays[1:] |= inside[:-1]  # the first space after a term
    heads = offsets[:-1][offsets[:-1] < len(data)]
    stays[heads] &= inside[heads]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    stays[tails] &= inside[tails]
    kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
    # a space before nothing but separators up to the end of its text
    out = data[stays]
    ends = kept[1:][kept[1:] > kept[:-1]] - 1
    ends = ends[out[ends] == 32]
    if len(ends):
        gone = np.zeros(len(out) + 1, np.int64)
        gone[ends + 1] = 1
        kept = kept - np.cumsum(gone)[kept]
        out = np.delete(out, ends)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(out))


def term_texts(docs: DataFrame) -> DataFrame:
    """lang, source and the text as its terms with spaces."""

    def terms(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = spaced(part.column(2)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["lang", "source", "text"])

    return docs.mapInArrow(terms, "lang string, source string, text string")


def _of_part(part: int, parts: int):
    return lambda term: F.pmod(F.xxhash64(term), F.lit(parts)) == part


def _vectorized(rows: DataFrame, min_df: int) -> tuple[DataFrame, list[str]] | None:
    """(source, index, count) sums of the documents' sparse vectors, and the vocabulary; None without kept terms."""
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=MOST).fit(rows)
    if not model.vocabulary:
        return None
    sparse = F.unwrap_udt("vector")
    entries = model.transform(rows).select("source", F.inline(F.arrays_zip(sparse["indices"].alias("index"), sparse["values"].alias("n"))))
    entries = entries.toDF("source", "index", "n")
    return entries.groupBy("source", "index").agg(F.sum(F.col("n").cast("long")).alias("n")), model.vocabulary


def _local(spark, **columns: pa.Array) -> DataFrame:
    """A small table of the driver's, of a size that Spark knows."""
    return spark.createDataFrame(pa.table(columns))


def _p(n, total) -> F.Column:
    """1 + floor(10**9 (n + 5) / total)"""
    top = (F.coalesce(n, F.lit(0)) + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, total.cast("decimal(20,0)")) + 1


def _tile(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of the pairs of two tiles of sources over a block of terms.

    counts: at (source's number), index, p; groups: at, tile, p0, and terms of the block."""
    lang_no, _, _, first, second = (k.as_py() for k in key)
    order = np.argsort(groups["at"].to_numpy())
    at, tile, base = (groups[c].to_numpy()[order] for c in ("at", "tile", "p0"))
    indices, column = np.unique(counts["index"].to_numpy(), return_inverse=True)
    p = np.repeat(base[:, None], len(indices), axis=1)
    p[np.searchsorted(at, counts["at"].to_numpy()), column] = counts["p"].to_numpy()
    absent = int(groups["block_terms"][0].as_py()) - len(indices) if len(at) else 0
    left, right, value = [], [], []
    for k in np.flatnonzero(tile == first):
        others = np.flatnonzero((tile == second) & (at > at[k]))
        sums = np.abs(p[others] - p[k]).sum(1) + absent * np.abs(base[others] - base[k])
        left.append(np.full(len(others), at[k]))
        right.append(at[others])
        value.append(sums)
    done = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    n = sum(map(len, left))
    return pa.table({"lang_no": np.full(n, lang_no, np.int64), "a": done(left), "b": done(right), "value": done(value)})


def source_divergence(
    docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, parts: int = 1, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")).select(blank("lang"), blank("source"), blank("text"))
    # one row for each language
    names_ = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]
    langs = _local(spark, lang_no=pa.array(range(len(names_)), pa.int64()), lang=pa.array(names_, pa.string()))
    path = new_path(spark, "divergence-terms")
    term_texts(docs).join(langs, "lang").select("lang_no", "source", "text").write.partitionBy("lang_no").option("compression", "zstd").parquet(path)
    read = lambda: spark.read.schema("source string, text string, lang_no long").parquet(path)
    groups = read().select("lang_no", "source").distinct()
    number = F.row_number().over(Window.partitionBy("lang_no").orderBy("source")) - 1
    groups = keep(groups.withColumn("at", number.cast("long")).withColumn("tile", F.floor(F.col("at") / TILE)), "divergence-groups")

    sums, words, sizes = [], [], []
    for lang_no in range(len(names_)):
        rows = read().where(F.col("lang_no") == lang_no)
        rows = rows.select("source", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("terms"))
        for part in range(parts):
            mine = rows
            if parts > 1:
                mine = rows.withColumn("terms", F.filter("terms", _of_part(part, parts)))
            made = _vectorized(mine, min_df)
            if made is None:
                continue
            table, vocabulary = made
            where = [F.lit(lang_no).cast("long").alias("lang_no"), F.lit(part).alias("part")]
            sums.append(keep(table.select(*where, "source", "index", "n"), "divergence-sums"))
            index = pa.table({"index": pa.array(range(len(vocabulary)), pa.int32()), "term": vocabulary})
            words.append(keep(spark.createDataFrame(index).select(*where, "index", "term"), "divergence-words"))
            sizes.append((lang_no, part, len(vocabulary)))
    out_columns = ["lang", "source", "part", "item", "value", "rank"]
    kept = [sum(size for k, _, size in sizes if k == lang_no) for lang_no in range(len(names_))]
    whole = _local(spark, lang_no=pa.array(range(len(names_)), pa.int64()), v=pa.array(kept, pa.int64()))
    none = spark.createDataFrame([], "lang_no long, part int, source string, index int, n long")
    counts = reduce(DataFrame.unionByName, sums) if sums else none
    names = reduce(DataFrame.unionByName, words) if words else none.select("lang_no", "part", "index", F.col("source").alias("term"))

    totals = counts.groupBy("lang_no", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang_no", "source"], "left").join(whole, "lang_no").withColumn("total", F.coalesce("total", F.lit(0)) + 5 * F.col("v"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("total"))).otherwise(0))
    valued = counts.join(groups.select("lang_no", "source", "at", "tile", "total"), ["lang_no", "source"]).withColumn("p", _p(F.col("n"), F.col("total")))
    valued = keep(valued.select("lang_no", "part", "source", "at", "tile", "index", "n", "p"), "divergence-values")
    groups = keep(groups, "divergence-bases")

    # terms of a group that are commoner there than in the language
    word_sums = valued.groupBy("lang_no", "part", "index").agg(F.sum("n").alias("all"))
    # one row for each language
    sums_ = {r.lang_no: r.n for r in valued.groupBy("lang_no").agg(F.sum("n").alias("n")).collect()}
    lang_totals = _local(spark, lang_no=pa.array(list(sums_), pa.int64()), lang_total=pa.array([n + 5 * kept[k] for k, n in sums_.items()], pa.int64()))
    words_ = names.join(word_sums, ["lang_no", "part", "index"]).join(lang_totals, "lang_no")
    words_ = words_.select("lang_no", "part", "index", "term", _p(F.col("all"), F.col("lang_total")).alias("q"))
    terms = valued.where("n > 0").join(words_, ["lang_no", "part", "index"]).where("p > q")
    terms = terms.select("lang_no", "source", F.lit("term").alias("kind"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang_no", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(terms).where(F.col("rank") <= top)

    # pairs of sources: partial sums by block of terms and pair of tiles
    last = {r.lang_no: r.last for r in groups.groupBy("lang_no").agg(F.max("tile").alias("last")).collect()}
    cells = _local(  # one row for each vectorizer
        spark,
        lang_no=pa.array([k for k, _, _ in sizes], pa.int64()),
        part=pa.array([part for _, part, _ in sizes], pa.int32()),
        size=pa.array([size for _, _, size in sizes], pa.int64()),
        blocks=pa.array([-(-size // BLOCK) for _, _, size in sizes], pa.int64()),
        last=pa.array([last[k] for k, _, _ in sizes], pa.int64()),
    )
    pair = F.expr("flatten(transform(sequence(0L, last), a -> transform(sequence(a, last), b -> struct(a as first, b as second))))")
    cells = cells.withColumn("pairs", pair)
    mine = F.filter("pairs", lambda x: (x["first"] == F.col("tile")) | (x["second"] == F.col("tile")))
    left = valued.join(cells.select("lang_no", "part", "blocks", "pairs"), ["lang_no", "part"])
    left = left.select("lang_no", "part", F.pmod("index", "blocks").alias("block"), F.explode(mine).alias("x"), "at", "index", "p").select("*", "x.*").drop("x")
    right = groups.join(cells.select("lang_no", "part", "size", "blocks", "pairs"), "lang_no")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = F.floor((F.col("size") - F.col("block") + F.col("blocks") - 1) / F.col("blocks"))
    right = right.select("lang_no", "part", "block", F.explode(mine).alias("x"), "at", "tile", "p0", held.alias("block_terms")).select("*", "x.*").drop("x")
    keys = ["lang_no", "part", "block", "first", "second"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile, "lang_no long, a long, b long, value long")
    apart = partial.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))
    both = apart.unionByName(apart.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda k, to: groups.select("lang_no", F.col("at").alias(k), F.col("source").alias(to))
    both = both.join(name("a", "source"), ["lang_no", "a"]).join(name("b", "item"), ["lang_no", "b"])
    # languages without kept terms: every pair has the value 0
    bare = groups.where("v = 0").select("lang_no", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang_no").where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = both.select("lang_no", "source", "item", "value").unionByName(zeros.select("lang_no", "source", "item", "value"))
    pairs = ranked(pairs.select("lang_no", "source", F.lit("pair").alias("kind"), "item", "value"))
    out = pairs.unionByName(terms).join(langs, "lang_no")
    return out.select("lang", "source", F.col("kind").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")).select(*out_columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
z AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN v USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(x.total), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * z.v)::HUGEINT AS p,
         1 + (1000000000 * (v.n + 5)::HUGEINT) // (z.total + 5 * z.v)::HUGEINT AS q
  FROM g JOIN z USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
a AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
r AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM b LEFT JOIN a USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 50"""
