"""License scan by diagonal voting, in DataFrame operations only.

Every run of ``k`` words of a document is hashed and joined with the runs of the license
templates.  A match at document word p and template word q votes for the diagonal p - q of its
template.  Diagonals next to each other (a few words put in or left out) are merged into one
cluster, a cluster is cut into spans where as many words as the template has go without a match, and a span is
verified: the share of the template's words that its matching runs
cover, counted once each, must reach ``share``.  Runs are joined on their hash and their words,
so a vote is never a hash collision.

Next to the labels of the method stand the base labels: places where fixed phrases stand word for
word.  Words are runs of ASCII letters and digits and non-ASCII characters, in lower case.

Documents without any template run are told by an overlap of their hashes with the templates'
and carry no words further; the templates are checked to be few enough for that to be a literal,
beyond that every document's runs go to the join.

Defined results: null and empty texts have no words, labels are the empty string, score 0;
repeated rows are scanned each; ``first_word``/``last_word`` are null without a base phrase;
an empty table gives an empty result; extra columns are ignored.  Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import LICENSES
from .scratch import keep

#: License notices and their labels.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("reserved", "All rights reserved"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = (*NOTICES, *LICENSES)
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN, NEAR, SHARE, FEW = 3, 2, 0.7, 4096


def _words(text):
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def lowered(text):
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_runs(spark, templates=TEMPLATES, k: int = RUN) -> DataFrame:
    """(template, label, size, t_at, run, hash) of all runs of the templates."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, label string, text string").withColumn("w", _words(F.col("text")))
    t = t.withColumn("size", F.size("w")).where(F.col("size") >= k)
    runs = F.transform(F.sequence(F.lit(0), F.col("size") - k), lambda i: F.concat_ws(" ", F.slice("w", i + 1, k)))
    t = t.select("template", "label", "size", F.posexplode(runs).alias("t_at", "run"))
    return t.withColumn("hash", F.xxhash64("run"))


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    k: int = RUN,
    near: int = NEAR,
    share: float = SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score; spans has doc_id, label, template, first_word, last_word, votes, covered (share of the template)."""
    spark = docs.sparkSession
    runs = template_runs(spark, templates, k)
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), _words(body).alias("w"), F.contains(lowered(body), F.lit("license")).alias("_any"))
    d = d.withColumn("n_words", F.size("w"))

    def stands(i, phrase):
        found = F.lit(True)
        for j, word in enumerate(phrase.split()):
            found = found & (F.get("w", i + j) == word)
        return F.coalesce(found, F.lit(False))

    any_phrase = lambda i: F.array_contains(F.array(*[stands(i, p) for p, _ in phrases]), True)
    ending = all(p.split()[-1] == "license" for p, _ in phrases)
    places = F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), any_phrase)
    no_ints = F.array().cast("array<int>")
    d = d.withColumn("_at", F.when((F.col("n_words") > 0) & (F.col("_any") | F.lit(not ending)), places).otherwise(no_ints))

    def anywhere(phrase):
        return F.exists("_at", lambda i: stands(i, phrase))

    names = [F.when(anywhere(p), F.lit(label)) for p, label in phrases]

    hashes = [r.hash for r in runs.select("hash").distinct().limit(FEW + 1).collect()]
    if len(hashes) <= FEW:
        # the hash of a run from its words, without building the run
        two = lambda w, i: F.xxhash64(w, *[F.get("w", i + j) for j in range(1, k)])
        t = spark.createDataFrame([(x,) for _, x in templates], "text string").withColumn("w", _words(F.col("text")))
        heads = [x for r in t.select(F.transform("w", two).alias("h"), F.size("w").alias("n")).collect() for x in r.h[: max(r.n - k + 1, 0)]]
        candidate = F.arrays_overlap(F.transform("w", two), F.array(*[F.lit(h) for h in sorted(set(heads))])) if heads else F.lit(False)
    else:
        candidate = F.lit(True)
    d = d.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_compact(F.array(*names)).alias("_base"),
        F.when((F.col("n_words") >= k) & candidate, F.col("w")).alias("w"),
    )
    d = keep(d, "license-rows")

    grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.concat_ws(" ", F.slice("w", i + 1, k)))
    hits = d.where("w is not null").select("_row", F.posexplode(grams).alias("at", "run")).withColumn("hash", F.xxhash64("run"))
    hits = hits.join(runs, ["hash", "run"]).select("_row", "template", "label", "size", "at", "t_at", (F.col("at") - F.col("t_at")).alias("line"))
    # neighbouring diagonals become one cluster
    order = Window.partitionBy("_row", "template").orderBy("line")
    new = F.coalesce((F.col("line") - F.lag("line").over(order) > near).cast("int"), F.lit(0))
    cluster = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("_new", new).withColumn("cluster", cluster)
    # and a cluster is cut where a template's length of the document has no match, so that a span is one place
    along = Window.partitionBy("_row", "template", "cluster").orderBy("at", "t_at")
    apart = F.coalesce((F.col("at") - F.lag("at").over(along) > F.col("size")).cast("int"), F.lit(0))
    place = F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("_new", apart).withColumn("place", place)
    covered = hits.select("_row", "template", "label", "size", "cluster", "place", "at", F.explode(F.sequence("t_at", F.col("t_at") + k - 1)).alias("t"))
    spans = covered.groupBy("_row", "template", "label", "size", "cluster", "place").agg(
        (F.count_distinct("t") / F.col("size")).alias("covered"),
        F.min("at").cast("long").alias("first_word"),
        (F.max("at") + k - 1).cast("long").alias("last_word"),
        F.count_distinct("at").alias("votes"),
    )
    spans = keep(spans.where(F.col("covered") >= share), "license-spans")
    found = spans.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("covered").alias("_covered"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    rows = d.drop("w").join(found, "_row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("_base")).alias("base_labels"),
        joined(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("_covered", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
    spans = spans.join(d.select("_row", "doc_id"), "_row").drop("_row", "size", "cluster", "place")
    return rows, spans


def oracle(templates=TEMPLATES, phrases=PHRASES, k: int = RUN, near: int = NEAR, share: float = SHARE) -> str:
    """The rows of scan_licenses() as DuckDB SQL."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(templates))
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
  FROM documents),
p(phrase, label, n) AS (VALUES {base}),
b AS (
  SELECT r, pos0, label FROM (SELECT r, w, unnest(range(len(w))) AS pos0 FROM d) x, p
  WHERE array_to_string(w[pos0 + 1:pos0 + n], ' ') = phrase),
bs AS (
  SELECT r, count(DISTINCT pos0) AS n_base, min(pos0) AS first_word, max(pos0) AS last_word,
         list_sort(list(DISTINCT label)) AS base FROM b GROUP BY r),
t AS (
  SELECT template, label, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w
  FROM (VALUES {quoted}) v(template, label, body)),
tr AS (
  SELECT template, label, len(w) AS size, t_at, array_to_string(w[t_at + 1:t_at + {k}], ' ') AS run
  FROM (SELECT *, unnest(range(len(w) - {k - 1})) AS t_at FROM t)),
h AS (
  SELECT r, template, label, size, pos0, t_at, pos0 - t_at AS line
  FROM (SELECT r, pos0, array_to_string(w[pos0 + 1:pos0 + {k}], ' ') AS run
        FROM (SELECT r, w, unnest(range(len(w) - {k - 1})) AS pos0 FROM d WHERE len(w) >= {k})) g JOIN tr USING (run)),
l AS (
  SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY r, template ORDER BY line) > {near} THEN 1 ELSE 0 END AS new
  FROM (SELECT DISTINCT r, template, line FROM h)),
c AS (SELECT r, template, line, sum(new) OVER (PARTITION BY r, template ORDER BY line) AS cluster FROM l),
hc AS (
  SELECT h.*, cluster, CASE WHEN pos0 - lag(pos0) OVER v > size THEN 1 ELSE 0 END AS new
  FROM h JOIN c ON c.r = h.r AND c.template = h.template AND c.line = h.line
  WINDOW v AS (PARTITION BY h.r, h.template, cluster ORDER BY pos0, t_at)),
hp AS (SELECT *, sum(new) OVER (PARTITION BY r, template, cluster ORDER BY pos0, t_at ROWS UNBOUNDED PRECEDING) AS place FROM hc),
v AS (
  SELECT r, template, label, cluster, place, count(DISTINCT t) / any_value(size) AS covered
  FROM (SELECT r, template, label, size, cluster, place, unnest(range(t_at, t_at + {k})) AS t FROM hp)
  GROUP BY r, template, label, cluster, place),
m AS (SELECT r, list(DISTINCT label) AS more, max(covered) AS covered FROM v WHERE covered >= {share} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       greatest(coalesce(covered, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN m USING (r)"""
