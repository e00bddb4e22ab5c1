"""Queries of windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import columns as c
from folio.operators import ordering as o
from folio.operators import windows as w
from folio.plans.aggregating import _FILES, files
from folio.plans.normalise import CALLS_SQL, costed
from folio.plans.registry import query

_STORY = "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS text FROM conversations WHERE role <> 'system'"


def story(t):
    text = F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text"))
    return t.conversations.where("role <> 'system'").select("conv_id", "turn", text.alias("text"))


@query(
    "w1_neighbour_context",
    f"""WITH p AS ({_STORY}), n AS (SELECT *, lag(text) OVER v AS b, lead(text) OVER v AS a FROM p WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text, CASE WHEN b IS NULL THEN '{w.FIRST_PAGE}' WHEN b = '' THEN '{w.NO_TEXT_BEFORE}' ELSE b END AS previous,
    CASE WHEN a IS NULL THEN '{w.LAST_PAGE}' WHEN a = '' THEN '{w.NO_TEXT_AFTER}' ELSE a END AS "next" FROM n""",
)
def w1(t):
    return w.neighbour_context(story(t), "conv_id", "turn", "text")


_FLANKED = f"""WITH p AS ({_STORY}), l AS (SELECT *, length(trim(text)) >= 20 AS layer FROM p),
f AS (SELECT *, coalesce(lag(layer) OVER v, false) AND coalesce(lead(layer) OVER v, false) AS flanked FROM l WINDOW v AS (PARTITION BY conv_id ORDER BY turn)) """


@query("w2_flanked", _FLANKED + "SELECT conv_id, turn, layer, flanked FROM f")
def w2(t):
    return w.flanked(story(t).withColumn("layer", w.has_layer("text")), "conv_id", "turn", "layer").drop("text")


@query(
    "w3_routed",
    f"""WITH p AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS text FROM conversations),
    s AS (SELECT *, length(trim(text)) >= 20 AS layer FROM p WHERE role <> 'system'),
    f AS (SELECT *, coalesce(lag(layer) OVER v, false) AND coalesce(lead(layer) OVER v, false) AS flanked FROM s WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, role, CASE WHEN layer THEN 'layer' WHEN flanked AND conv_id % 2 = 0 AND conv_id % 3 <> 0 THEN 'skipped_wordless' ELSE 'ocr' END AS text_source FROM f
    UNION ALL SELECT conv_id, turn, role, CASE WHEN length(trim(text)) >= 20 THEN 'layer' ELSE 'none' END FROM p WHERE role = 'system'""",
)
def w3(t):
    text = F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text"))
    pages = t.conversations.select(
        "conv_id",
        "turn",
        "role",
        text.alias("text"),
        (F.col("role") != "system").alias("story"),
        (F.col("conv_id") % 2 == 0).alias("flows"),
        F.when(F.col("conv_id") % 3 == 0, True).alias("missing"),
    )
    return w.routed(pages, "conv_id", "turn", "text", "story", "flows", "missing").select("conv_id", "turn", "role", "text_source")


@query(
    "w4_separator_split",
    """WITH m AS (SELECT event_id, user_id, value < 10 AND event_id % 40 < 30 AS sep FROM events),
    n AS (SELECT *, sum(CAST(sep AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM m)
    SELECT user_id, event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY n) AS INTEGER) AS "group" FROM n WHERE NOT sep""",
)
def w4(t):
    frames = t.events.select("event_id", "user_id", F.col("value").alias("mean"), (F.col("event_id") % 40 + 10).alias("p99"))
    return w.split_at_separators(frames, "user_id", "event_id", w.is_separator("mean", "p99")).select("user_id", "event_id", "group")


@query(
    "w5_cover_split",
    """WITH m AS (SELECT event_id, user_id, CAST(event_type = 'signup' AND user_id % 5 <> 0 AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS INTEGER) AS cut FROM events)
    SELECT user_id, event_id, CAST(1 + sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS "group", sum(cut) OVER (PARTITION BY user_id) = 0 AS single FROM m""",
)
def w5(t):
    cover = (F.col("event_type") == "signup") & (F.col("user_id") % 5 != 0)
    return w.split_at_covers(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", cover).drop("event_type")


@query(
    "w6_preferred",
    f"""WITH f AS (SELECT doc_id, {_FILES} AS file FROM documents), n AS (SELECT *, trim(regexp_replace(lower(file), '[^a-z0-9]+', ' ', 'g')) AS norm, file LIKE 'Book %' AS plain FROM f)
    SELECT norm, file, doc_id FROM n QUALIFY row_number() OVER (PARTITION BY norm ORDER BY plain DESC, CASE WHEN plain THEN file END DESC, file, doc_id) = 1""",
)
def w6(t):
    rows = files(t).withColumn("norm", c.normal_title("file"))
    order = [F.desc("plain"), F.desc(F.when(F.col("plain"), F.col("file"))), F.asc("file"), F.asc("doc_id")]
    return w.preferred(rows, "norm", order).select("norm", "file", "doc_id")


@query(
    "w7_first_wins",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1""",
)
def w7(t):
    out = w.first_wins(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "w8_appended",
    """SELECT l_orderkey, l_partkey, l_suppkey, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity) AS page_number FROM lineitem""",
)
def w8(t):
    name = F.concat(F.lit("img"), F.col("l_partkey").cast("string"))
    pages = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.lit(3).cast("long").alias("start"))
    out = w.appended(pages, "l_orderkey", "start", [o.natural_key(name), F.col("l_suppkey"), F.col("l_quantity")])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "page_number")


@query(
    "w9_breaker",
    """WITH r AS (SELECT user_id, event_id, event_type IN ('purchase') AS ok FROM events WHERE event_type IN ('purchase', 'error', 'click')),
    i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM i WHERE NOT ok)
    SELECT user_id, min(event_id) AS at FROM n WHERE n = 5 GROUP BY user_id""".replace(" AS at ", ' AS "at" '),
)
def w9(t):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type").isin("error", "click"), "fail").otherwise("neutral")
    return w.tripped(t.events.withColumn("outcome", outcome), "user_id", "event_id", "outcome")


@query("w10_unique_titles")
def w10(t):
    """Greedy by position, so without SQL; tests hold it against a loop."""
    titles = t.part.select("p_partkey", F.when(F.col("p_partkey") % 97 != 0, F.col("p_name")).alias("title"))
    have = t.part.where("p_partkey % 10 = 0").select(c.document_id(F.concat("p_name", F.lit(" (3)"))).alias("id")).distinct()
    return w.unique_titles(titles, "title", "p_partkey", have, "id")


@query(
    "w11_cluster_sample",
    """WITH k AS (SELECT l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) ORDER BY md5('7:' || CAST(l_suppkey AS VARCHAR)), l_suppkey LIMIT 10),
    d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem JOIN k USING (l_suppkey))
    SELECT l_suppkey, l_orderkey FROM d QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('7:' || CAST(l_orderkey AS VARCHAR)), l_orderkey) <= 5""",
)
def w11(t):
    return w.cluster_sample(t.lineitem.select("l_suppkey", "l_orderkey").distinct(), "l_suppkey", "l_orderkey", 10, 5, 7, w.hashed_order)


@query(
    "w12_simple_sample",
    "SELECT doc_id FROM documents WHERE length(replace(text, ' ', '')) >= 60 ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50",
)
def w12(t):
    long = F.char_length(F.translate("text", " ", "")) >= 60
    return w.simple_sample(t.documents, "doc_id", long, 50, 3, w.hashed_order).select("doc_id")


@query(
    "s1_natural_sort",
    r"""WITH f AS (SELECT p_partkey, 'p' || CAST(p_size AS VARCHAR) || '_' || lpad(CAST(p_partkey % 13 AS VARCHAR), 3, '0') || '.jpg' AS file FROM part)
    SELECT p_partkey, file, row_number() OVER (ORDER BY CAST(regexp_extract(file, 'p([0-9]+)', 1) AS INTEGER), CAST(regexp_extract(file, '_([0-9]+)', 1) AS INTEGER), p_partkey) AS place FROM f""",
)
def s1(t):
    number = F.lpad((F.col("p_partkey") % 13).cast("string"), 3, "0")
    file = F.concat(F.lit("p"), F.col("p_size").cast("string"), F.lit("_"), number, F.lit(".jpg"))
    rows = t.part.select("p_partkey", file.alias("file"))
    return o.numbered(rows, [o.natural_key("file"), F.col("p_partkey")])


_QUEUE = """SELECT o_orderkey, o_orderpriority || ' Title' AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'submitted' END AS status, o_orderstatus = 'F' AS validated,
 o_custkey % 2 = 0 AS needs_review, o_custkey % 4 = 0 AS high_priority, o_custkey % 5 AS n_flagged, 'u' || CAST(o_custkey % 7 AS VARCHAR) AS entered_by FROM orders"""


def queue(t):
    cust = F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        F.concat("o_orderpriority", F.lit(" Title")).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, "submitted").alias("status"),
        (F.col("o_orderstatus") == "F").alias("validated"),
        (cust % 2 == 0).alias("needs_review"),
        (cust % 4 == 0).alias("high_priority"),
        (cust % 5).alias("n_flagged"),
        F.concat(F.lit("u"), (cust % 7).cast("string")).alias("entered_by"),
    )


@query(
    "s2_validation_queue",
    f"""WITH q AS ({_QUEUE}) SELECT o_orderkey, title || CASE WHEN n_flagged > 0 THEN ' (' || CAST(n_flagged AS VARCHAR) || ' flagged)' ELSE '' END AS label, needs_review, high_priority
    FROM q WHERE NOT validated AND status = 'submitted' AND entered_by = 'u3' ORDER BY high_priority DESC, needs_review DESC, lower(title)""",
)
def s2(t):
    return o.validation_queue(queue(t), submitted_only=True, owner="u3").select("o_orderkey", "label", "needs_review", "high_priority")


@query(
    "s3_review_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_quantity <= 40, lower(l_returnflag), l_linenumber, l_orderkey, l_partkey, l_suppkey) AS place
    FROM lineitem WHERE l_tax > 0.06""",
)
def s3(t):
    rows = t.lineitem.where("l_tax > 0.06").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    order = [*o.review_order(F.col("l_quantity") > 40, "l_returnflag", "l_linenumber"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")]
    return o.numbered(rows, order).drop("l_quantity", "l_returnflag")


@query("s4_time_added", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'signup'")
def s4(t):
    return o.numbered(t.events.where("event_type = 'signup'").select("event_id", "ts"), [F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    "s5_cost_order",
    CALLS_SQL + "SELECT model, operation, round(sum(cost_usd), 4) AS cost_usd, row_number() OVER (ORDER BY sum(cost_usd) DESC, model, operation) AS place FROM costs GROUP BY model, operation",
)
def s5(t):
    sums = costed(t).groupBy("model", "operation").agg(F.sum("cost_usd").alias("cost_usd"))
    return o.numbered(sums, [-F.col("cost_usd"), F.col("model"), F.col("operation")]).withColumn("cost_usd", F.round("cost_usd", 4))


@query("s6_first_matched", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) ORDER BY o_orderkey LIMIT 25")
def s6(t):
    keys = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").orderBy("o_orderkey").limit(25).select("o_orderkey")


@query("s7_top_match", "SELECT p_brand, max(p_retailprice) AS price, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def s7(t):
    best = F.max(F.struct("p_retailprice", "p_partkey")).alias("b")
    return t.part.groupBy("p_brand").agg(best).select("p_brand", F.col("b.p_retailprice").alias("price"), F.col("b.p_partkey").alias("p_partkey"))


@query(
    "s8_titled_order",
    "SELECT p_partkey, row_number() OVER (ORDER BY lower(CASE WHEN p_size % 9 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END), p_partkey) AS place FROM part",
)
def s8(t):
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 9 == 0, "  ").otherwise(F.col("p_name")).alias("title"))
    return o.numbered(rows, o.titled_order("title", "p_partkey")).drop("title")


@query("u1_key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u1(t):
    return o.key_difference(t.customer, t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(
    "u2_own_books",
    f"""WITH q AS ({_QUEUE}) SELECT o_orderkey, entered_by, CASE WHEN entered_by = 'u0' THEN 'system' WHEN status = 'submitted' THEN 'submitted' ELSE 'in progress' END AS shelf
    FROM q WHERE entered_by IN ('u1', 'u0')""",
)
def u2(t):
    return o.own_books(queue(t), "u1", "u0").select("o_orderkey", "entered_by", "shelf")


@query(
    "u3_distinct_union",
    "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 7 OR l_partkey < 20",
)
def u3(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("path"))
    return o.distinct_union(rows.where("l_suppkey = 7"), rows.where("l_partkey < 20"), "path").select("l_orderkey", "l_partkey")


@query(
    "u4_missing_slots",
    """WITH s AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS l_linenumber FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM s ANTI JOIN lineitem l USING (l_orderkey, l_linenumber)""",
)
def u4(t):
    return o.missing_slots(t.lineitem, "l_orderkey", "l_linenumber")


@query(
    "u4_missing_ranges",
    """WITH s AS (SELECT DISTINCT user_id, event_id + 1 AS n FROM events),
    l AS (SELECT user_id, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY n), 0) + 1 AS "first", n - 1 AS "last" FROM s)
    SELECT user_id, "first", "last" FROM l WHERE "first" <= "last" """,
)
def u4_ranges(t):
    return o.missing_ranges(t.events.select("user_id", (F.col("event_id") + 1).alias("n")), "user_id", "n")


@query(
    "u5_manifest_matches",
    """WITH h AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS have FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_custkey % 5 < 2 THEN false ELSE coalesce(have = range(1, 1 + o_custkey % 5), false) END AS complete FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""",
)
def u5(t):
    k = F.col("o_custkey") % 5
    listed = F.when(k == 0, F.array().cast("array<int>")).when(k > 1, F.reverse(F.sequence(F.lit(1), k.cast("int"))))
    manifests = t.orders.select("o_orderkey", listed.alias("uploaded"))
    return o.manifest_matches(manifests, "o_orderkey", "uploaded", t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "l_linenumber")
