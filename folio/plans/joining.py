"""Queries of joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import columns as c
from folio.operators import joins as j
from folio.functions.replies import scored
from folio.plans.registry import query
from folio.sources.shared import shared_path
from folio.sources.snapshots import Store


@query(
    "a2_lookup",
    """SELECT k.c_custkey * 3 AS o_orderkey, o_totalprice, o_orderkey IS NOT NULL AS "exists" FROM customer k LEFT JOIN orders o ON o.o_orderkey = k.c_custkey * 3
    """,
)
def a2(t):
    ids = t.customer.select((F.col("c_custkey") * 3).alias("o_orderkey"))
    return j.lookup(ids, t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(
    "a3_lookup_in_order",
    """SELECT s_suppkey, pos, o_orderkey, o_custkey FROM (SELECT s_suppkey, unnest([0, 1, 2]) AS pos,
    unnest([s_suppkey * 7, s_suppkey, s_suppkey * 7]) AS o_orderkey FROM supplier) LEFT JOIN orders USING (o_orderkey)""",
)
def a3(t):
    refs = F.array(F.col("s_suppkey") * 7, F.col("s_suppkey"), F.col("s_suppkey") * 7)
    asked = t.supplier.select("s_suppkey", refs.alias("refs"))
    return j.lookup_in_order(asked, "refs", t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


@query("a4_existing", "SELECT DISTINCT o_custkey + 700 AS c_custkey FROM orders WHERE o_custkey + 700 IN (SELECT c_custkey FROM customer)")
def a4(t):
    ids = t.orders.select((F.col("o_custkey") + 700).alias("c_custkey")).distinct()
    return j.existing(ids, t.customer, "c_custkey")


_PARTS = "SELECT *, trim(regexp_replace(lower(p_name || '!' || p_brand || ' ' || CAST(p_partkey AS VARCHAR)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part"


def _parts(t):
    return t.part.withColumn("norm", c.normal_title(F.concat("p_name", F.lit("!"), "p_brand", F.lit(" "), F.col("p_partkey").cast("string"))))


@query(
    "j1_reconcile",
    f"""WITH p AS ({_PARTS}), l AS (SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_quantity > 49 GROUP BY 1),
    s AS (SELECT norm, lines FROM p JOIN l ON l_partkey = p_partkey), z AS (SELECT norm, p_retailprice AS price FROM p WHERE p_size > 25)
    SELECT p.p_partkey, p.norm, lines, price, s.norm IS NOT NULL AS has_lines, z.norm IS NOT NULL AS has_prices
    FROM p LEFT JOIN s USING (norm) LEFT JOIN z USING (norm)""",
)
def j1(t):
    p = _parts(t)
    lines = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"))
    sources = {
        "lines": p.join(lines, "p_partkey").select("norm", "lines"),
        "prices": p.where("p_size > 25").select("norm", F.col("p_retailprice").alias("price")),
    }
    return j.reconcile(p.select("p_partkey", "norm"), sources, "norm")


@query(
    "j2_coverage",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000),
    d AS (SELECT DISTINCT l_suppkey * 20 AS k FROM lineitem WHERE l_quantity > 45)
    SELECT k, k IN (SELECT k FROM a) AS in_sheet, k IN (SELECT k FROM b) AS in_db, k IN (SELECT k FROM d) AS in_files
    FROM (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM d)""",
)
def j2(t):
    return j.coverage(
        {
            "sheet": t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")),
            "db": t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")),
            "files": t.lineitem.where("l_quantity > 45").select((F.col("l_suppkey") * 20).alias("k")),
        },
        "k",
    )


@query(
    "j3_dangling",
    """WITH r AS (SELECT 'lineitem' AS child, CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_linenumber = 7 THEN NULL
      WHEN l_linenumber = 6 THEN 'suppliers/' || CAST(l_partkey AS VARCHAR) ELSE 'parts/' || CAST(l_partkey + 40 AS VARCHAR) END AS ref, 'parts' AS want FROM lineitem
      UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'customers/' || CAST(o_custkey * 2 AS VARCHAR), 'customers' FROM orders),
    keys AS (SELECT 'parts/' || CAST(p_partkey AS VARCHAR) AS ref FROM part UNION ALL SELECT 'customers/' || CAST(c_custkey AS VARCHAR) FROM customer)
    SELECT child, id, ref, CASE WHEN ref IS NULL THEN 'no reference' WHEN NOT starts_with(ref, want || '/') THEN 'wrong collection' ELSE 'missing target' END AS reason
    FROM r WHERE ref IS NULL OR NOT starts_with(ref, want || '/') OR ref NOT IN (SELECT ref FROM keys)""",
)
def j3(t):
    n = F.col("l_linenumber")
    part = lambda k: F.col("l_partkey").cast("string") if not k else (F.col("l_partkey") + k).cast("string")
    ref = F.when(n == 6, F.concat(F.lit("suppliers/"), part(0))).when(n != 7, F.concat(F.lit("parts/"), part(40)))
    lines = t.lineitem.select(F.col("l_orderkey").cast("string").alias("id"), ref.alias("ref"))
    orders = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("customers/"), (F.col("o_custkey") * 2).cast("string")).alias("ref"))
    a = j.dangling(lines, "id", "ref", t.part, "p_partkey", "parts").withColumn("child", F.lit("lineitem"))
    b = j.dangling(orders, "id", "ref", t.customer, "c_custkey", "customers").withColumn("child", F.lit("orders"))
    return a.unionByName(b)


_HOST = r"regexp_extract(url, '//([^/]*)', 1)"


@query(
    "j4_orphan_folders",
    f"""WITH o AS (SELECT CASE WHEN page_id % 50 = 0 THEN 'uploads' ELSE {_HOST} END AS folder, url LIKE 'https:%' AS is_page FROM pages)
    SELECT folder, count(*) FILTER (is_page) AS n_pages FROM o WHERE folder <> 'uploads' AND folder NOT IN (SELECT {_HOST} FROM pages WHERE page_id % 3 = 1)
    GROUP BY folder HAVING count(*) FILTER (is_page) >= 1""",
)
def j4(t):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    objects = t.pages.select(F.when(F.col("page_id") % 50 == 0, "uploads").otherwise(host).alias("folder"), F.col("url").startswith("https:").alias("is_page"))
    return j.orphan_folders(objects, t.pages.where("page_id % 3 = 1").select(host.alias("book")), "folder", "book")


def _fuzzy_names(t):
    # names with a letter dropped, against the names themselves
    asked = t.part.select(F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 99), F.lit(" "), F.lower("p_type")).alias("name"))
    options = t.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("option"))
    return asked, options


@query("j5_fuzzy_match")
def j5(t):
    """Python's matching-blocks ratio has no SQL form; tests hold it against difflib."""
    asked, options = _fuzzy_names(t)
    return j.fuzzy_match(asked, "name", options, "option")


@query("j6_photo_matches")
def j6(t):
    asked, options = _fuzzy_names(t)
    extracted = asked.unionByName(t.customer.select(F.col("c_mktsegment").alias("name"))).distinct()
    return j.fuzzy_match(extracted, "name", options, "option").withColumn("matched", F.col("match").isNotNull())


@query("j7_resolve_or_create")
def j7(t):
    entities = t.supplier.select(c.document_id("s_name").alias("id"), "s_name")
    names = t.supplier.select(F.concat(F.lit("Suplier#"), F.substring("s_name", 10, 9)).alias("n")).unionByName(
        t.customer.select(F.concat_ws(" ", "c_mktsegment", F.lit("House")).alias("n"))
    )
    return j.resolve_or_create(names, "n", entities, "id", "s_name", c.document_id("name"))


@query(
    "j8_alias_targets",
    """WITH ch AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS target FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    al AS (SELECT l_orderkey, 8 - l_linenumber AS l_linenumber, l_suppkey AS alias FROM lineitem)
    SELECT l_orderkey, l_linenumber, alias, target, target IS NOT NULL AS resolved FROM al LEFT JOIN ch USING (l_orderkey, l_linenumber)""",
)
def j8(t):
    keys = ["l_orderkey", "l_linenumber"]
    characters = t.lineitem.where("l_returnflag <> 'R'").groupBy(*keys).agg(F.min("l_partkey").alias("id"))
    aliases = t.lineitem.select("l_orderkey", (8 - F.col("l_linenumber")).alias("l_linenumber"), F.col("l_suppkey").alias("alias"))
    return j.alias_targets(aliases, characters, keys, "id")


@query(
    "j9_scope",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))",
)
def j9(t):
    chosen = t.customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("keys"))
    return j.in_scope(t.orders, "o_custkey", chosen).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "j10_search_names",
    """SELECT p_partkey, p_name, s_name AS supplier, n_name AS nation FROM part JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(p_name), 'bolt') AND l_linenumber = 1""",
)
def j10(t):
    hits = c.contains_search(t.part, "p_name", "bolt").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    books = hits.join(t.lineitem.where("l_linenumber = 1").select("l_partkey", "l_suppkey"), "l_partkey")
    out = books.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.col("s_name").alias("supplier")), "l_suppkey", "left")
    out = j.with_names(out, [(t.nation.select("n_nationkey", "n_name"), "n_nationkey", "s_nationkey", "nation")])
    return out.select(F.col("l_partkey").alias("p_partkey"), "p_name", "supplier", "nation")


@query(
    "j11_nested",
    """SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus), '') AS books
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE contains(lower(c_name), '7') GROUP BY c_custkey""",
)
def j11(t):
    authors = c.contains_search(t.customer, "c_name", "7").select("c_custkey")
    out = j.nested(authors, "c_custkey", t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["o_orderkey", "o_orderstatus"], "books")
    shown = F.transform("books", lambda b: F.concat_ws(":", b["o_orderkey"].cast("string"), b["o_orderstatus"]))
    return out.select("c_custkey", F.array_join(shown, ",").alias("books"))


@query(
    "j12_flagged_pages",
    """WITH p AS (SELECT *, CAST(l_orderkey AS VARCHAR) AS o, '_' || CAST(l_linenumber AS VARCHAR) AS tail FROM lineitem WHERE l_returnflag = 'A'),
    r AS (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN 'books/' || o ELSE '' END AS ref, CASE l_linenumber % 4 WHEN 1 THEN o || tail WHEN 2 THEN 'loose' ELSE '' END AS page FROM p),
    b AS (SELECT *, coalesce(regexp_extract(nullif(ref, ''), '[^/]*$'), nullif(CASE WHEN ends_with(page, tail) THEN substring(page, 1, length(page) - length(tail)) END, ''), nullif(page, ''), '(unknown book)') AS book FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, book, o_orderpriority AS title FROM b LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = book""",
)
def j12(t):
    k = F.col("l_linenumber") % 4
    order = F.col("l_orderkey").cast("string")
    pages = t.lineitem.where("l_returnflag = 'A'").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(k == 0, F.concat(F.lit("books/"), order)).otherwise("").alias("ref"),
        F.when(k == 1, F.concat_ws("_", order, F.col("l_linenumber").cast("string"))).when(k == 2, "loose").otherwise("").alias("page_id"),
    )
    pages = pages.withColumn("book", j.page_book(pages, "ref", "page_id", "l_linenumber")).drop("ref", "page_id")
    return j.with_names(pages, [(t.orders.select(F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority"), "k", "book", "title")])


@query(
    "j13_not_known",
    """SELECT s.doc_id, s.source, s.name, s.name IN (SELECT lower(lang) FROM documents e WHERE e.source = s.source AND e.doc_id % 3 = 0) AS skipped
    FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'zz' END AS name FROM documents) s""",
)
def j13(t):
    have = t.documents.where("doc_id % 3 = 0").select("source", F.concat(F.lit(" "), F.upper("lang")).alias("name"))
    suggested = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("zz").alias("name"))
    return j.not_known(suggested, have, "source", "name")


@query(
    "j14_backfilled_list",
    """WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS have FROM lineitem GROUP BY 1)
    SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN coalesce(have, [])
      ELSE list_filter(['zz', coalesce(have[1], 'q'), '1'], lambda x: list_contains(coalesce(have, []), x)) END, ',') AS list
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def j14(t):
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("child"))
    first = children.groupBy("o_orderkey").agg(F.min("child").alias("f"))
    own = F.when(F.col("o_orderkey") % 2 != 0, F.array(F.lit("zz"), F.coalesce("f", F.lit("q")), F.lit("1")))
    parents = t.orders.select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", own.alias("listed"))
    out = j.backfilled_list(parents, "o_orderkey", "listed", children, "child")
    return out.select("o_orderkey", F.array_join("list", ",").alias("list"))


_VARIANTS = "CASE WHEN l_linenumber % 3 = 0 THEN '_display' WHEN l_linenumber % 3 = 1 THEN '' ELSE '_cropped' END"


@query(
    "j15_missing_derivatives",
    f"""SELECT l_orderkey AS folder, l_suppkey % 3 AS page, CASE WHEN bool_or(v = '_cropped') THEN '_cropped' ELSE '' END AS source
    FROM (SELECT *, {_VARIANTS} AS v FROM lineitem) GROUP BY 1, 2 HAVING bool_or(v = '') AND NOT bool_or(v = '_display')""",
)
def j15(t):
    k = F.col("l_linenumber") % 3
    variant = F.when(k == 0, "_display").when(k == 1, "").otherwise("_cropped")
    return j.missing_derivatives(t.lineitem.select(F.col("l_orderkey").alias("folder"), (F.col("l_suppkey") % 3).alias("page"), variant.alias("variant")))


@query(
    "j16_by_priority",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand WHEN i.item_id IS NOT NULL THEN i.text END AS title,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 1950 AS VARCHAR) END AS year FROM part LEFT JOIN benchmark i ON i.item_id = p_partkey""",
)
def j16(t):
    size = F.col("p_size")
    title = t.part.select("p_partkey", F.when(size % 3 == 0, F.col("p_name")).otherwise("  ").alias("title"), F.lit(None).cast("int").alias("year"))
    copyright_ = t.part.select("p_partkey", F.when(size % 3 == 1, F.col("p_brand")).alias("title"), F.when(size % 2 == 0, size + 1950).alias("year"))
    catalogue = t.benchmark.select(F.col("item_id").alias("p_partkey"), F.col("text").alias("title"), F.lit(1999).alias("year"))
    return j.by_priority(t.part, "p_partkey", [title, copyright_, catalogue], ["title", "year"], {"year": {2}})


@query(
    "j17_cached",
    r"""WITH d AS (SELECT doc_id, sha1(lang || chr(0) || coalesce(text, '')) AS key, length(text) AS n FROM documents),
    hit AS (SELECT DISTINCT key FROM d WHERE doc_id % 2 = 0)
    SELECT doc_id, key, CASE WHEN key IN (SELECT key FROM hit) THEN -1 ELSE n END AS score, key IN (SELECT key FROM hit) AS cached FROM d""",
)
def j17(t):
    docs = t.documents.select("doc_id", "lang", "text")
    text = F.concat("lang", F.lit("\x00"), F.coalesce("text", F.lit("")))
    cache = docs.where("doc_id % 2 = 0").select(F.sha1(text.cast("binary")).alias("key")).distinct().withColumn("score", F.lit(-1).cast("long"))

    def scorer(misses):
        return misses.select("key", F.char_length("text").cast("long").alias("score"), F.lit(True).alias("ok"))

    out, _ = j.cached(docs, ["lang", "text"], cache, scorer, "score long")
    return out.select("doc_id", "key", "score", "cached")


@query(
    "j17_score_once",
    r"""WITH d AS (SELECT doc_id, sha1(lang || chr(0) || coalesce(text, '')) AS key, length(text) AS n FROM documents),
    hit AS (SELECT DISTINCT key FROM d WHERE doc_id % 2 = 0 AND n <= 3000)
    SELECT doc_id, key, CASE WHEN n <= 3000 THEN CAST(n AS DOUBLE) END AS score, key IN (SELECT key FROM hit) AS cached FROM d""",
)
def j17_score_once(t):
    """Half of the documents are scored and kept; then all are asked for, and only new texts and failures are scored."""
    store = Store(t.spark, shared_path(t.spark, "results"))
    docs = t.documents.select("doc_id", "lang", "text")

    def scorer(misses):
        return scored(misses, "key", "text", _short).withColumn("ok", F.col("error").isNull())

    j.score_once(docs.where("doc_id % 2 = 0"), ["lang", "text"], store, "scores", scorer, "score double", "half", 0)
    out = j.score_once(docs, ["lang", "text"], store, "scores", scorer, "score double", "all", 0)
    return out.select("doc_id", "key", "score", "cached")


def _short(text):
    if len(text) > 3000:
        raise ValueError("too long")
    return len(text)


@query(
    "j18_name_dimension",
    """WITH d AS (SELECT replace(lower(n_name), '_', ' ') AS name, n_nationkey AS id FROM nation UNION ALL SELECT 'nation ' || CAST(s_nationkey % 3 AS VARCHAR), s_suppkey + 1000 FROM supplier)
    SELECT name, max(id) AS id FROM d GROUP BY name""",
)
def j18(t):
    names = t.nation.select(F.translate(F.lower("n_name"), "_", " ").alias("n"), F.col("n_nationkey").cast("long").alias("id"))
    more = t.supplier.select(F.concat(F.lit("nation "), (F.col("s_nationkey") % 3).cast("string")).alias("n"), (F.col("s_suppkey") + 1000).alias("id"))
    return j.name_dimension(names.unionByName(more).withColumn("at", F.col("id")), "n", "id", "at")
