"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import columns as c
from folio.operators import aggs as g
from folio.operators import joins as j
from folio.plans.normalise import CALLS_SQL, costed
from folio.plans.registry import query

_GENDERS = ("A", "N", "R", "X")


@query(
    "g1_gender_breakdown",
    """WITH f AS (SELECT CASE WHEN l_linenumber = 7 THEN 'other' ELSE l_returnflag END AS gender, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_linestatus = 'F' END AS human
      FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))),
    s AS (SELECT gender, chart FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(gender), (VALUES ('human'), ('non_human'), ('combined')) b(chart)),
    n AS (SELECT s.chart, s.gender, count(*) FILTER (f.gender IS NOT NULL AND (chart = 'combined' OR (chart = 'human') = coalesce(human, false))) AS n
      FROM s LEFT JOIN f USING (gender) GROUP BY 1, 2)
    SELECT chart, gender, n, n * 100.0 / (SELECT count(*) FROM f) AS pct FROM n""",
)
def g1(t):
    customers = c.equal_to(t.customer, "c_mktsegment", "BUILDING").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("keys"))
    orders = j.in_scope(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", customers)
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    facts = facts.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    facts = facts.select(
        F.when(F.col("l_linenumber") == 7, "other").otherwise(F.col("l_returnflag")).alias("gender"),
        F.when(F.col("l_linenumber") != 6, F.col("l_linestatus") == "F").alias("human"),
    )
    return g.gender_breakdown(facts, "gender", "human", _GENDERS, t.spark)


_USAGE = """WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN 'big' ELSE 'small' END AS model, event_type AS flow,
  CAST(round(value * 100) AS BIGINT) AS cost_usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, user_id AS output_tokens,
  event_id % 5 AS cache_read, event_id % 3 AS cache_write FROM events),
r AS (SELECT day, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(flow) = 0 THEN 'flow' ELSE 'total' END AS level,
  CASE WHEN grouping(model) = 0 THEN model WHEN grouping(flow) = 0 THEN flow END AS key, count(*) AS calls, CAST(sum(cost_usd) AS BIGINT) AS cost_usd,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write FROM u GROUP BY GROUPING SETS ((day), (day, model), (day, flow))) """


def usage(t):
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("user_id") % 2 == 0, "big").otherwise("small").alias("model"),
        F.col("event_type").alias("flow"),
        F.round(F.col("value") * 100).cast("long").alias("cost_usd"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
        (F.col("event_id") % 5).alias("cache_read"),
        (F.col("event_id") % 3).alias("cache_write"),
    )


@query("g2_usage_rollup", _USAGE + "SELECT * FROM r")
def g2(t):
    return g.usage_rollup(usage(t))


@query(
    "g3_usage_summary",
    _USAGE
    + """, d AS (SELECT *, date_diff('day', CAST(day AS DATE), DATE '2024-01-20') AS age FROM r)
    SELECT span, level, key, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cost_usd) AS BIGINT) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write
    FROM (SELECT *, 'recent' AS span FROM d WHERE age BETWEEN 0 AND 29 UNION ALL SELECT *, 'today' FROM d WHERE age = 0) GROUP BY span, level, key""",
)
def g3(t):
    return g.usage_summary(g.usage_rollup(usage(t)), "2024-01-20")


@query(
    "g4_cost_report",
    CALLS_SQL
    + """SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(operation) = 0 THEN 'operation' ELSE 'total' END AS level, operation, model, count(*) AS calls,
    round(sum(cost_usd), 4) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CASE WHEN grouping(operation) = 1 THEN round(sum(cost_usd) / count(DISTINCT l_orderkey), 6) END AS cost_per_book FROM costs GROUP BY ROLLUP (operation, model)""",
)
def g4(t):
    out = g.cost_report(costed(t), "l_orderkey")
    return out.withColumns({"cost_usd": F.round("cost_usd", 4), "cost_per_book": F.round("cost_per_book", 6)})


_OVERLAP = r"""WITH c AS (SELECT count(*) AS items FROM benchmark),
d AS (SELECT doc_id, text AS a, doc_id % items AS item_id FROM documents, c),
p AS (SELECT doc_id, a, b.text AS b FROM d JOIN benchmark b USING (item_id)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9]+')) AS w, 1 AS a, 0 AS b FROM p
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(b, '')), '[a-z0-9]+')), 0, 1 FROM p),
k AS (SELECT doc_id, w, sum(a) AS a, sum(b) AS b FROM w GROUP BY 1, 2),
s AS (SELECT doc_id, sum(least(a, b)) AS i, sum(greatest(a, b)) AS u, sum(b) AS r FROM k GROUP BY 1),
o AS (SELECT doc_id, coalesce(i / nullif(u, 0), 1.0) AS jaccard, coalesce(i / nullif(r, 0), 1.0) AS containment FROM p LEFT JOIN s USING (doc_id)) """


def overlaps(t):
    pairs = t.documents.select("doc_id", "text", (F.col("doc_id") % t.benchmark.count()).alias("item_id"))
    pairs = pairs.join(t.benchmark.select("item_id", F.col("text").alias("reference")), "item_id").drop("item_id")
    return g.overlap(pairs, ["doc_id"], "text", "reference")


@query("g5_bag_jaccard", _OVERLAP + "SELECT doc_id, round(jaccard, 9) AS jaccard FROM o")
def g5(t):
    return overlaps(t).select("doc_id", F.round("jaccard", 9).alias("jaccard"))


@query("g6_containment", _OVERLAP + "SELECT doc_id, round(containment, 9) AS containment FROM o")
def g6(t):
    return overlaps(t).select("doc_id", F.round("containment", 9).alias("containment"))


_CLEANED = """CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, 200) WHEN 2 THEN text || ' Extra' WHEN 3 THEN '' END"""
_KEPT = rf"""WITH d AS (SELECT doc_id, text, {_CLEANED} AS cleaned FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) AS w, 1 AS d FROM d
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(coalesce(cleaned, ''), '[0-9A-Za-z]+')), -1 FROM d),
n AS (SELECT doc_id, min(n) AS least FROM (SELECT doc_id, w, sum(d) AS n FROM w GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT d.*, trim(coalesce(cleaned, '')) <> '' AND coalesce(least, 0) >= 0 AS kept FROM d LEFT JOIN n USING (doc_id)) """


def cleaned(t):
    k = F.col("doc_id") % 5
    new = F.when(k == 0, F.col("text")).when(k == 1, F.substring("text", 1, 200)).when(k == 2, F.concat("text", F.lit(" Extra"))).when(k == 3, "")
    return t.documents.select(
        "doc_id",
        "text",
        new.alias("cleaned"),
        F.when(k != 4, F.col("doc_id") % 3 != 0).alias("sense"),
        F.when(k != 4, F.col("doc_id") % 2 != 0).alias("fits"),
    )


@query("g7_only_removed", _KEPT + "SELECT doc_id, kept FROM k")
def g7(t):
    return g.only_removed(cleaned(t), "text", "cleaned").select("doc_id", "kept")


@query(
    "g8_clean_outcome",
    _KEPT
    + r""", s AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'failed' WHEN trim(cleaned) = '' OR trim(cleaned) = text THEN 'unchanged' WHEN kept THEN 'cleaned' ELSE 'rejected' END AS status FROM k),
    f AS (SELECT *, CASE WHEN status = 'cleaned' THEN trim(cleaned) ELSE text END AS final_text, doc_id % 5 = 4 OR doc_id % 3 <> 0 AS sense, doc_id % 5 = 4 OR doc_id % 2 <> 0 AS fits FROM s),
    v AS (SELECT *, CASE WHEN sense AND fits THEN '' WHEN NOT fits AND (NOT sense OR trim(final_text) = '') THEN 'high' ELSE 'normal' END AS p FROM f)
    SELECT doc_id, status, final_text, status IN ('failed', 'rejected') OR NOT (sense AND fits) AS needs_review,
    CASE WHEN status = 'failed' THEN 'normal' WHEN status = 'rejected' AND p <> 'high' THEN 'normal' ELSE p END AS priority FROM v""",
)
def g8(t):
    return g.clean_outcome(cleaned(t), "doc_id", "text", "cleaned", "sense", "fits")


@query("g9_ordered_text", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE coalesce(text, '') <> '' AND role <> 'system' GROUP BY conv_id")
def g9(t):
    return g.ordered_text(t.conversations.where("role <> 'system'"), "conv_id", "turn", "text", "\n\n")


@query(
    "g10_cross_check",
    _OVERLAP
    + """SELECT round(avg(containment), 6) AS containment, round(avg(jaccard), 6) AS jaccard, count(*) FILTER (containment < 0.85) AS below,
    (SELECT count(*) FROM documents WHERE coalesce(lang, '') <> 'en') AS no_reference FROM o JOIN documents USING (doc_id) WHERE lang = 'en'""",
)
def g10(t):
    """The references are English, so texts in other languages have none."""
    english = t.documents.where("lang = 'en'").select("doc_id")
    out = g.cross_check(overlaps(t).join(english, "doc_id", "left_semi"), t.documents.select("doc_id"), "doc_id")
    return out.withColumns({"containment": F.round("containment", 6), "jaccard": F.round("jaccard", 6)})


@query(
    "g11_review_flags",
    """WITH b AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS f, coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_returnflag = 'R'), '') AS pages,
      bool_or(l_returnflag = 'R' AND l_quantity > 40) AS high, concat_ws('; ', CASE WHEN count(*) < 2 THEN 'no pages' END, CASE WHEN max(l_tax) < 0.03 THEN 'no characters' END) AS note FROM lineitem GROUP BY 1)
    SELECT l_orderkey, f OR note <> '' AS needs_review, pages, high, note FROM b""",
)
def g11(t):
    lines = t.lineitem.withColumns({"flag": F.col("l_returnflag") == "R", "urgent": F.col("l_quantity") > 40})
    reasons = {"no pages": F.count("*") < 2, "no characters": F.max("l_tax") < 0.03}
    out = g.review_flags(lines, "l_orderkey", "l_linenumber", "flag", "urgent", reasons)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query(
    "g12_totals",
    """WITH b AS (SELECT o_orderpriority = '5-LOW' AS skipped, o_orderstatus = 'F' AS referenced, o_custkey AS author, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 77 END AS illustrator, o_orderpriority AS publisher FROM orders),
    p AS (SELECT l_orderkey AS book, l_linestatus = 'F' AS story, l_quantity < 10 AS image, l_returnflag = 'A' AS layer, l_returnflag = 'R' AS ocr, l_returnflag = 'N' AS skip, l_discount < 0.02 AS cleaned,
      l_discount >= 0.09 AS rejected, l_tax > 0.06 AS flagged, l_quantity > 40 AS high, l_linenumber = 7 AS ocr_failed, l_linenumber = 6 AS judge_failed FROM lineitem)
    SELECT b.*, p.*, (SELECT count(*) FROM part) AS characters, (SELECT count(*) FROM supplier) AS aliases,
      (SELECT count(DISTINCT author) FROM b WHERE NOT skipped AND author IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS authors_existing,
      (SELECT count(DISTINCT illustrator) FROM b WHERE NOT skipped AND illustrator IN (SELECT s_suppkey FROM supplier)) AS illustrators_existing,
      (SELECT count(DISTINCT publisher) FROM b WHERE NOT skipped AND publisher = '1-URGENT') AS publishers_existing
    FROM (SELECT count(*) FILTER (NOT skipped) AS books, count(*) FILTER (skipped) AS books_skipped, count(*) FILTER (NOT skipped AND NOT referenced) AS no_reference,
      count(DISTINCT author) FILTER (NOT skipped) AS authors, count(DISTINCT illustrator) FILTER (NOT skipped) AS illustrators, count(DISTINCT publisher) FILTER (NOT skipped) AS publishers FROM b) b,
    (SELECT count(*) AS pages, count(*) FILTER (story) AS story_pages, count(*) FILTER (image) AS images, count(*) FILTER (layer) AS pages_text_layer, count(*) FILTER (ocr) AS pages_needing_ocr,
      count(*) FILTER (skip) AS pages_skipped_ocr, count(*) FILTER (cleaned) AS pages_cleaned, count(*) FILTER (rejected) AS pages_clean_rejected, count(*) FILTER (flagged) AS pages_flagged,
      count(*) FILTER (flagged AND high) AS pages_flagged_high, count(*) FILTER (ocr_failed) AS ocr_failed, count(*) FILTER (judge_failed) AS judge_failed, count(DISTINCT book) FILTER (flagged) AS books_flagged FROM p) p""",
)
def g12(t):
    books = t.orders.select(
        (F.col("o_orderpriority") == "5-LOW").alias("skipped"),
        (F.col("o_orderstatus") == "F").alias("referenced"),
        F.col("o_custkey").alias("author"),
        F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 77).alias("illustrator"),
        F.col("o_orderpriority").alias("publisher"),
    )
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    pages = t.lineitem.select(
        F.col("l_orderkey").alias("book"),
        (F.col("l_linestatus") == "F").alias("story"),
        (F.col("l_quantity") < 10).alias("image"),
        (flag == "A").alias("layer"),
        (flag == "R").alias("ocr"),
        (flag == "N").alias("skipped"),
        (F.col("l_discount") < 0.02).alias("cleaned"),
        (F.col("l_discount") >= 0.09).alias("rejected"),
        (F.col("l_tax") > 0.06).alias("flagged"),
        (F.col("l_quantity") > 40).alias("high"),
        (n == 7).alias("ocr_failed"),
        (n == 6).alias("judge_failed"),
    )
    existing = {
        "author": t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")),
        "illustrator": t.supplier.select(F.col("s_suppkey").alias("id")),
        "publisher": t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("id")),
    }
    return g.corpus_totals(books, pages, t.part, t.supplier, existing)


@query(
    "g13_image_counts",
    """SELECT o_orderkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) <= 2 THEN 'only ' || CAST(coalesce(n, 0) AS VARCHAR) || ' page ' || CASE WHEN n = 1 THEN 'image' ELSE 'images' END END AS reason
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def g13(t):
    return g.image_counts(t.orders, "o_orderkey", t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")))


@query(
    "g14_last_page",
    """SELECT o_orderkey, coalesce(n, 0) AS highest, greatest(coalesce(n, 0), o_custkey % 9) AS append_at
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def g14(t):
    books = t.orders.select("o_orderkey", (F.col("o_custkey") % 9).alias("declared"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return g.last_page(books, "o_orderkey", "declared", pages, "l_linenumber")


@query("g15_flag_summary", "SELECT count(*) AS flagged, count(*) FILTER (l_quantity > 40) AS high, count(DISTINCT l_orderkey) AS books FROM lineitem WHERE l_returnflag = 'R'")
def g15(t):
    rows = t.lineitem.where("l_returnflag = 'R'")
    return rows.agg(F.count("*").alias("flagged"), F.count_if(F.col("l_quantity") > 40).alias("high"), F.count_distinct("l_orderkey").alias("books"))


_FILES = "CASE WHEN doc_id % 3 = 0 THEN 'Book ' || lang || ' ' || CAST(doc_id % 50 AS VARCHAR) ELSE 'book-' || lang || '-' || CAST(doc_id % 50 AS VARCHAR) END"


def files(t):
    name = F.concat("lang", F.lit("-"), (F.col("doc_id") % 50).cast("string"))
    plain = F.concat(F.lit("Book "), "lang", F.lit(" "), (F.col("doc_id") % 50).cast("string"))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, plain).otherwise(F.concat(F.lit("book-"), name)).alias("file"), (F.col("doc_id") % 3 == 0).alias("plain"))


@query(
    "g16_duplicate_groups",
    f"""WITH f AS (SELECT {_FILES} AS file FROM documents), n AS (SELECT *, trim(regexp_replace(lower(file), '[^a-z0-9]+', ' ', 'g')) AS norm FROM f)
    SELECT norm, count(*) AS n, string_agg(DISTINCT file, '|' ORDER BY file) AS files FROM n GROUP BY norm HAVING count(*) > 1""",
)
def g16(t):
    rows = files(t).withColumn("norm", c.normal_title("file"))
    out = rows.groupBy("norm").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("file")), "|").alias("files"))
    return out.where("n > 1")


@query("g17_duplicate_names", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def g17(t):
    return g.duplicate_names(t.events, ["user_id", "event_type"])


@query(
    "g18_fingerprint",
    """SELECT conv_id, md5(CAST(count(*) AS VARCHAR) || substring(first(text ORDER BY turn), 1, 65536) || substring(last(text ORDER BY turn), 1, 65536)) AS fingerprint FROM conversations GROUP BY conv_id""",
)
def g18(t):
    return g.fingerprint(t.conversations, "conv_id", "turn", "text")


@query(
    "g19_judge_comparison",
    _OVERLAP
    + """SELECT round(avg(CAST(quality = 1 AS INTEGER)), 9) AS guard_rate, round(avg(CAST(quality = toxic AS INTEGER)), 9) AS agreement, round(avg(jaccard), 6) AS jaccard,
    count(*) FILTER (quality = toxic) AS agreed, count(*) FILTER (quality <> toxic) AS disagreed FROM labels JOIN o USING (doc_id)""",
)
def g19(t):
    rows = t.labels.join(overlaps(t), "doc_id")
    same = F.col("quality") == F.col("toxic")
    return rows.agg(
        F.round(F.avg((F.col("quality") == 1).cast("int")), 9).alias("guard_rate"),
        F.round(F.avg(same.cast("int")), 9).alias("agreement"),
        F.round(F.avg("jaccard"), 6).alias("jaccard"),
        F.count_if(same).alias("agreed"),
        F.count_if(~same).alias("disagreed"),
    )


@query(
    "g20_accuracy",
    """WITH r AS (SELECT doc_id, quality = toxic AS ok, lang, source FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT ok, unnest(['ALL', 'lang=' || lang, 'source=' || source]) AS category FROM r)
    SELECT category, count(*) FILTER (ok) AS correct, count(*) AS total, count(*) FILTER (ok) * 100.0 / count(*) AS pct FROM c GROUP BY 1""",
)
def g20(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").withColumn("ok", F.col("quality") == F.col("toxic"))
    return g.accuracy(rows, "doc_id", "ok", ["lang", "source"])


@query("g20_flips", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def g20_flips(t):
    return g.flips(t.events, "user_id", "event_type")


@query(
    "g21_rotation_grid",
    """WITH i AS (SELECT p_partkey, p_size % 2 = 0 AS spread, unnest([0, 90, 180, 270]) AS angle FROM part)
    SELECT p_partkey, angle, (360 - angle) % 360 AS want, CASE WHEN angle % 180 <> 0 THEN NOT spread ELSE spread END AS want_spread,
    CASE WHEN angle <> 180 THEN (p_partkey % 4) * 90 = (360 - angle) % 360 ELSE false END AS ok FROM i""",
)
def g21(t):
    items = t.part.select("p_partkey", (F.col("p_size") % 2 == 0).alias("spread"))
    guesses = t.part.select("p_partkey", F.explode(F.array(F.lit(0), F.lit(90), F.lit(270))).alias("angle"), ((F.col("p_partkey") % 4) * 90).alias("predicted"))
    out = g.rotation_grid(items, "p_partkey", guesses, "spread")
    return out.select("p_partkey", "angle", "want", "want_spread", "ok")


@query(
    "g22_joint_error",
    """SELECT CAST(sum(least(a, b)) AS BIGINT) AS worst, CAST(sum(a) AS BIGINT) AS bad_a, CAST(sum(b) AS BIGINT) AS bad_b FROM (SELECT user_id,
    count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (value > 30) AS b FROM events GROUP BY 1)""",
)
def g22(t):
    return g.joint_error(t.events, "user_id", F.col("event_type") == "error", F.col("value") > 30)


@query(
    "g23_complete_jobs",
    """SELECT o_orderkey, coalesce(n, 0) = o_custkey % 4 AS complete FROM orders LEFT JOIN (SELECT o_orderkey, count(DISTINCT l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_returnflag <> 'N' AND l_linenumber BETWEEN 1 AND o_custkey % 4 GROUP BY 1) USING (o_orderkey)""",
)
def g23(t):
    jobs = t.orders.select("o_orderkey", (F.col("o_custkey") % 4).alias("n_pages"))
    pages = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return g.complete_jobs(jobs, "o_orderkey", "n_pages", pages, "l_linenumber", F.col("l_returnflag") != "N")


@query(
    "g24_first_text",
    "SELECT conv_id, first(text ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' AND coalesce(text, '') <> '' GROUP BY conv_id",
)
def g24(t):
    return g.first_text(t.conversations, "conv_id", "turn", "text", F.col("role") == "assistant")
