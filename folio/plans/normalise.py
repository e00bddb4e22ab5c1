"""Queries of filters, normal forms, codes and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import columns as c
from folio.plans.registry import query

_NAMES = "SELECT p_partkey, p_name FROM part"
_JUNK_SQL = ", ".join(f"'{t}'" for t in c.JUNK_TOKENS)
_REAL_SQL = ", ".join(f"'{t}'" for t in c.REAL_NAMES)


@query(
    "n1_defaults",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, 'UNSET') AS segment,
    CASE WHEN c_custkey % 5 = 0 THEN -1.0 ELSE c_acctbal END AS balance, CAST(NULL AS VARCHAR) AS comment,
    CAST(-1 AS INTEGER) AS published FROM customer""",
)
def n1(t):
    df = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance"),
        F.lit(None).cast("string").alias("comment"),
    )
    return c.with_defaults(df, {"segment": "UNSET", "balance": -1.0, "comment": None, "published": -1})


@query("n2_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def n2(t):
    return c.equal_to(t.orders, "o_orderstatus", "F").select("o_orderkey", "o_totalprice")


@query(
    "n3_in",
    """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def n3(t):
    few = c.among(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    keys = c.equal_to(t.customer, "c_mktsegment", "BUILDING").select("c_custkey")
    return c.among(few, "o_custkey", keys).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("n4_range_search", "SELECT p_partkey, p_name FROM part WHERE p_name >= 'bl' AND p_name <= 'blz'")
def n4(t):
    return c.range_search(t.part, "p_name", "bl").select("p_partkey", "p_name")


@query("n5_contains_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def n5(t):
    return c.contains_search(t.part, "p_name", " RING ").select("p_partkey", "p_name")


@query(
    "n6_normal_title",
    r"""SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS norm
    FROM documents""",
)
def n6(t):
    return t.documents.select("doc_id", c.normal_title("text").alias("norm"))


@query(
    "n7_document_ids",
    """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS book_id,
    lower(replace(p_name, ' ', '_')) || '_' || CAST(p_size AS VARCHAR) AS page_id,
    lower(replace(p_name, ' ', '_')) || '_' || lower(replace(p_brand, ' ', '_')) AS character_id,
    lower(replace(p_type || ' ' || p_brand, ' ', '_')) AS person_id,
    CASE WHEN p_size % 2 = 0 THEN lower(replace(trim(p_brand), ' ', '_')) || '_' ELSE '' END
      || lower(replace(trim(p_name), ' ', '_')) AS collection_id FROM part""",
)
def n7(t):
    book = c.document_id("p_name")
    owner = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    return t.part.select(
        "p_partkey",
        book.alias("book_id"),
        c.document_id(book, "p_size").alias("page_id"),
        c.document_id(book, "p_brand").alias("character_id"),
        c.person_id("p_type", "p_brand").alias("person_id"),
        c.collection_id(owner, "p_name").alias("collection_id"),
    )


@query(
    "n8_identity",
    """SELECT c_custkey, coalesce(lower(trim(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '  ' || c_name || ' ' END)), '') AS username
    FROM customer""",
)
def n8(t):
    raw = F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return t.customer.select("c_custkey", c.identity(raw).alias("username"))


@query(
    "n9_split_name",
    r"""WITH w AS (SELECT s_suppkey, list_filter(regexp_split_to_array(trim(CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN s_name
      WHEN 2 THEN ' Jo ' || s_name ELSE 'Jo  van ' || s_name END), '\s+'), lambda x: x <> '') AS w FROM supplier)
    SELECT s_suppkey, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE coalesce(w[1], '') END AS forename,
    CASE WHEN len(w) > 1 THEN w[len(w)] ELSE '' END AS surname FROM w""",
)
def n9(t):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, "").when(k == 1, F.col("s_name")).when(k == 2, F.concat(F.lit(" Jo "), "s_name"))
    raw = raw.otherwise(F.concat(F.lit("Jo  van "), "s_name"))
    return t.supplier.select("s_suppkey", c.split_name(raw).alias("n")).select("s_suppkey", "n.forename", "n.surname")


@query(
    "n10_display_name",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || ' Smith' WHEN 2 THEN 'some publisher'
    ELSE 'Unknown' END AS shown FROM customer""",
)
def n10(t):
    k = F.col("c_custkey") % 4
    return t.customer.select(
        "c_custkey",
        c.display_name(
            F.when(k == 0, F.col("c_name")).otherwise("  "),
            F.when(k == 1, F.col("c_mktsegment")),
            F.when(k == 1, F.lit("Smith")),
            F.when(k == 2, F.lit("some_publisher")),
        ).alias("shown"),
    )


@query(
    "n11_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Woman' ELSE 'Unknown' END AS author_gender,
    CASE o_orderstatus WHEN 'F' THEN 'Female' ELSE 'Non-specific' END AS character_gender,
    o_orderstatus <> 'O' AS human, o_orderstatus IN ('O', 'P') AS recognised FROM orders""",
)
def n11(t):
    human = F.when(F.col("o_orderstatus") == "O", " nh").when(F.col("o_orderstatus") == "P", "H").otherwise("NO")
    return t.orders.select(
        "o_orderkey",
        c.author_gender(F.lower("o_orderstatus")).alias("author_gender"),
        c.character_gender("o_orderstatus").alias("character_gender"),
        c.human_code(human).alias("h"),
    ).select("o_orderkey", "author_gender", "character_gender", "h.human", "h.recognised")


@query(
    "n12_unknown",
    """SELECT doc_id, lower(trim(coalesce(s, ''))) IN ('', 'unknown', 'n/a', 'none', 'null') AS unknown FROM (
    SELECT doc_id, CASE source WHEN 'src1' THEN ' N/A ' WHEN 'src2' THEN 'Unknown' WHEN 'src3' THEN NULL ELSE source END AS s FROM documents)""",
)
def n12(t):
    s = F.when(F.col("source") == "src1", " N/A ").when(F.col("source") == "src2", "Unknown").when(F.col("source") != "src3", F.col("source"))
    return t.documents.select("doc_id", c.is_unknown(s).alias("unknown"))


_BOOL = "CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN NULL ELSE 'maybe' END"


@query(
    "n13_as_bool",
    f"""SELECT event_id, CASE WHEN lower(trim(v)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(v)) IN ('false', 'no', '0') THEN false
    ELSE false END AS flag, coalesce(lower(trim(v)) NOT IN ('false', 'no', '0'), true) AS flag_true
    FROM (SELECT event_id, {_BOOL} AS v FROM events)""",
)
def n13(t):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    v = F.when(k == 0, " Yes").when(k == 1, "FALSE").when(k == 2, "1").when(k == 4, "maybe")
    return t.events.select("event_id", c.as_bool(v, False).alias("flag"), c.as_bool(v, True).alias("flag_true"))


@query(
    "n14_year",
    r"""SELECT doc_id, CASE WHEN y BETWEEN 1900 AND 2025 THEN y END AS year FROM (
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(CAST(n_chars * 7 AS VARCHAR) || ' c. ' || CAST(1850 + doc_id % 220 AS VARCHAR), '[0-9]{4}'), '') AS INTEGER) AS y
    FROM documents)""",
)
def n14(t):
    raw = F.concat_ws(" c. ", (F.col("n_chars") * 7).cast("string"), (1850 + F.col("doc_id") % 220).cast("string"))
    return t.documents.select("doc_id", c.year_of(raw, 2025).alias("year"))


@query(
    "n15_page_range",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(floor(l_quantity / 10) AS INTEGER) AS s,
      CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(floor(l_tax * 100) AS INTEGER) END AS e FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, s >= 1 AND e >= s AND e IS NOT NULL AS usable,
    CASE WHEN s >= 1 AND e >= s THEN l_linenumber BETWEEN s AND e ELSE true END AS story FROM r""",
)
def n15(t):
    start = F.format_string(" %s ", F.floor(F.col("l_quantity") / 10).cast("string"))
    end = F.when(F.col("l_returnflag") == "R", "soon").otherwise(F.concat(F.floor(F.col("l_tax") * 100).cast("string"), F.lit(".7")))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        c.page_range(start, end).isNotNull().alias("usable"),
        c.in_story("l_linenumber", start, end).alias("story"),
    )


@query(
    "n16_author_field",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' Rose' WHEN 1 THEN '' WHEN 2 THEN c_name || ' and B C' ELSE c_name END AS author,
    CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'F' END AS code,
    CASE c_custkey % 5 WHEN 0 THEN 'Helen Oak' WHEN 1 THEN 'Allen Berg' ELSE '' END AS second, c_custkey % 5 IN (1, 2) AS review FROM customer""",
)
def n16(t):
    k = F.col("c_custkey") % 5
    author = F.when(k == 0, F.concat("c_name", F.lit(" Rose and Helen Oak"))).when(k == 1, F.concat("c_name", F.lit(" and Allen Berg")))
    author = author.when(k == 2, F.concat("c_name", F.lit(" and B C"))).otherwise(F.col("c_name"))
    code = F.when(k == 0, "M/F").when(k == 1, "F/M").when(k == 2, "M/F/M").otherwise("F")
    return t.customer.select("c_custkey", c.author_field(author, code).alias("a")).select("c_custkey", "a.*")


@query(
    "n17_blank_text",
    r"""SELECT page_id, CASE WHEN regexp_matches(regexp_replace(h, '<[^>]*>', '', 'g'), '[\p{L}\p{N}]') THEN h ELSE '' END AS text
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<p>"..." <br></p>' ELSE html END AS h FROM pages)""",
)
def n17(t):
    return t.pages.select("page_id", c.blank_text(F.when(F.col("page_id") % 3 == 0, '<p>"..." <br></p>').otherwise(F.col("html"))).alias("text"))


@query(
    "n18_isbn",
    r"""SELECT doc_id, regexp_replace(coalesce(nullif(regexp_extract(t, '97[89][-\s]?(?:[0-9][-\s]?){9}[0-9]'), ''),
    nullif(regexp_extract(t, '\b[0-9][-\s]?(?:[0-9][-\s]?){8}[0-9X]\b'), '')), '[-\s]', '', 'g') AS isbn
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ISBN 978-0-14-' || CAST(1000000 + doc_id AS VARCHAR) WHEN 1 THEN 'isbn 0 330 ' || CAST(100000 + doc_id AS VARCHAR)
      || ' ' ELSE text END AS t FROM documents)""",
)
def n18(t):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("ISBN 978-0-14-"), (1000000 + F.col("doc_id")).cast("string")))
    text = text.when(k == 1, F.concat(F.lit("isbn 0 330 "), (100000 + F.col("doc_id")).cast("string"), F.lit(" "))).otherwise(F.col("text"))
    return t.documents.select("doc_id", c.isbn(text).alias("isbn"))


@query(
    "n19_article",
    r"""SELECT p_partkey, CASE WHEN b = '' THEN trim(n) ELSE b END AS bare FROM (SELECT p_partkey, n,
    trim(regexp_replace(n, '^\s*(the|an|a|my|your|his|her|its|our|their)\s+', '', 'i')) AS b FROM (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' The ' || p_name WHEN 1 THEN 'my ' WHEN 2 THEN 'Another ' || p_name ELSE 'a the ' || p_name END AS n FROM part))""",
)
def n19(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit(" The "), "p_name")).when(k == 1, "my ").when(k == 2, F.concat(F.lit("Another "), "p_name"))
    return t.part.select("p_partkey", c.without_article(name.otherwise(F.concat(F.lit("a the "), "p_name"))).alias("bare"))


_JUNK_CASES = ("asdf", "Li", "12345", "aaaa!", "qwer99", "test book", "....", " ", "poiuyt x", "xy")
_JUNK_CASE_SQL = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_JUNK_CASES))


@query(
    "n20_junk_names",
    rf"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(CASE p_partkey % 14 {_JUNK_CASE_SQL} ELSE p_name END), '\s+', ' ', 'g')) AS n FROM part),
    d AS (SELECT *, replace(n, ' ', '') AS d FROM n)
    SELECT p_partkey, CASE WHEN n IN ({_REAL_SQL}) THEN NULL WHEN n = '' THEN 'empty' WHEN length(d) <= 2 THEN 'short'
    WHEN n IN ({_JUNK_SQL}) THEN 'placeholder'
    WHEN len(list_filter(string_split(n, ' '), lambda w: w NOT IN ({_JUNK_SQL}))) = 0 THEN 'all placeholders'
    WHEN replace(d, d[1], '') = '' THEN 'one character' WHEN regexp_full_match(d, '[0-9]+') THEN 'numeric'
    WHEN regexp_matches(d, '{c.keyboard_walks()}') THEN 'keyboard walk' END AS reason FROM d""",
)
def n20(t):
    k = F.col("p_partkey") % 14
    name = F.col("p_name")
    for i, x in enumerate(_JUNK_CASES):
        name = F.when(k == i, x).otherwise(name)
    return t.part.select("p_partkey", c.junk_reason(name).alias("reason"))


@query(
    "n21_owner",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'user_' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'user_' || CAST(o_custkey AS VARCHAR) END AS owner FROM orders""",
)
def n21(t):
    user = F.concat(F.lit("user_"), F.col("o_custkey").cast("string"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("users/"), user)).when(F.col("o_orderkey") % 3 == 1, user).otherwise("  ")
    return t.orders.select("o_orderkey", c.owner_of(raw).alias("owner"))


@query(
    "n22_role",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'team' WHEN c_acctbal > 5000 THEN 'admin' ELSE 'archivist' END AS role FROM customer""",
)
def n22(t):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "team").otherwise(F.lower("c_mktsegment"))
    return t.customer.select("c_custkey", c.effective_role(role, F.col("c_acctbal") > 5000).alias("role"))


@query(
    "n23_folder",
    r"""SELECT page_id, regexp_extract(regexp_replace(CASE WHEN page_id % 6 = 0 THEN 'Title ' || CAST(page_id AS VARCHAR) ELSE trim(url) END, '/+$', ''), '[^/]*$') AS folder FROM pages""",
)
def n23(t):
    url = F.when(F.col("page_id") % 6 != 0, F.col("url")).otherwise("  ")
    return t.pages.select("page_id", c.folder_of(url, F.concat(F.lit("Title "), F.col("page_id").cast("string"))).alias("folder"))


@query(
    "n24_email",
    r"""SELECT doc_id, word, regexp_matches(word, '^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$') AND length(word) <= 254 AS valid FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]*@[^ \n]*')) AS word FROM documents)""",
)
def n24(t):
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]*@[^ \n]*"), F.lit(0))).alias("word"))
    return words.select("doc_id", "word", c.is_email("word").alias("valid"))


@query(
    "n28_review_verdict",
    """SELECT doc_id, NOT (quality = 1 AND toxic = 0) AS needs_review, CASE WHEN quality = 1 AND toxic = 0 THEN ''
    WHEN toxic = 1 AND (quality = 0 OR doc_id % 2 = 0) THEN 'high' ELSE 'normal' END AS priority FROM labels""",
)
def n28(t):
    v = c.review_verdict(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 2 != 0)
    return t.labels.select("doc_id", v.alias("v")).select("doc_id", "v.*")


@query(
    "n29_skip_ocr",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN false ELSE quality = 1 AND NOT (doc_id % 4 <> 1 AND toxic = 1) END AS skip FROM labels""",
)
def n29(t):
    flows = F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1)
    return t.labels.select("doc_id", c.skip_ocr(flows, F.when(F.col("doc_id") % 4 != 1, F.col("toxic") == 1)).alias("skip"))


@query(
    "n30_reopen_block",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'validated' WHEN o_custkey % 3 = 0 THEN 'validation_active' END AS block FROM orders""",
)
def n30(t):
    return t.orders.select("o_orderkey", c.reopen_block(F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 == 0).alias("block"))


PRICES = [("O", 2.0, 10.0), ("F", 5.0, 25.0)]


def calls(t):
    """Model calls made of line items: model, operation, four token counts."""
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", "other").otherwise(F.col("l_linestatus")).alias("model"),
        F.col("l_returnflag").alias("operation"),
        "l_orderkey",
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("output_tokens"),
        F.col("l_linenumber").cast("long").alias("cache_read"),
        F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")).alias("cache_write"),
    )


CALLS_SQL = """WITH calls AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'other' ELSE l_linestatus END AS model, l_returnflag AS operation, l_orderkey,
  CAST(l_quantity AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens, CAST(l_linenumber AS BIGINT) AS cache_read,
  CASE WHEN l_linenumber > 3 THEN l_suppkey END AS cache_write FROM lineitem),
costs AS (SELECT c.*, coalesce(((input_tokens + cache_read * 0.1 + coalesce(cache_write, 0) * 1.25) * p.i + output_tokens * p.o) / 1e6, 0.0) AS cost_usd
  FROM calls c LEFT JOIN (VALUES ('O', 2.0, 10.0), ('F', 5.0, 25.0)) p(model, i, o) USING (model)) """


def costed(t):
    prices = t.spark.createDataFrame(PRICES, "model string, input double, output double")
    return c.token_cost(calls(t), prices)


@query("n31_token_cost", CALLS_SQL + "SELECT l_orderkey, model, cache_read, round(cost_usd, 9) AS cost_usd FROM costs")
def n31(t):
    return costed(t).select("l_orderkey", "model", "cache_read", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "n32_themes",
    """SELECT doc_id, quality = 1 OR toxic = 1 AS love, doc_id % 2 = 0 OR quality = 1 AS war,
    array_to_string(list_concat(CASE WHEN quality = 0 AND toxic = 1 THEN ['love'] ELSE [] END, CASE WHEN doc_id % 2 <> 0 AND quality = 1 THEN ['war'] ELSE [] END), ',') AS added
    FROM labels""",
)
def n32(t):
    df = t.labels.select(
        "doc_id",
        (F.col("quality") == 1).alias("o1"),
        F.when(F.col("toxic") == 1, True).alias("s1"),
        (F.col("doc_id") % 2 == 0).alias("o2"),
        (F.col("quality") == 1).alias("s2"),
    )
    merged, added = c.themes({"love": "o1", "war": "o2"}, {"love": "s1", "war": "s2"})
    return df.select("doc_id", *[v.alias(k) for k, v in merged.items()], F.array_join(added, ",").alias("added"))


@query(
    "n33_flow_key",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'unlabelled' ELSE replace('flow.' || event_type, '.', '_') END AS flow FROM events""",
)
def n33(t):
    raw = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" flow."), "event_type"))
    return t.events.select("event_id", c.flow_key(raw).alias("flow"))


@query(
    "n34_stamp",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old_user' ELSE 'me' END AS entered_by,
    CASE WHEN c_custkey % 2 = 0 THEN '2020-01-01' ELSE '2025-06-01' END AS datetime_created, true AS is_registered, '2025-06-01' AS last_updated FROM customer""",
)
def n34(t):
    old = F.col("c_custkey") % 2 == 0
    df = t.customer.select("c_custkey", F.when(old, "old_user").alias("entered_by"), F.when(old, "2020-01-01").alias("datetime_created"), (~old).alias("is_new"))
    return c.stamped(df, "me", "2025-06-01").drop("is_new")


@query(
    "n35_positions",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size, p_partkey % 60, 1, 1], lambda x: x BETWEEN 1 AND 40))), ',') AS pages FROM part""",
)
def n35(t):
    raw = F.array(F.concat(F.lit(" "), F.col("p_size").cast("string")), (F.col("p_partkey") % 60).cast("string"), F.lit("1"), F.lit("x"), F.lit("1"))
    return t.part.select("p_partkey", F.array_join(F.transform(c.positions(raw, F.lit(40)), lambda x: x.cast("string")), ",").alias("pages"))


@query(
    "n36_name_list",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '|' || p_brand ELSE '' END AS authors FROM part""",
)
def n36(t):
    k = F.col("p_partkey") % 4
    many = F.to_json(F.array("p_name", F.lit("  "), F.concat(F.lit(" "), "p_brand")))
    raw = F.when(k == 0, F.concat(F.lit('" '), "p_name", F.lit('"'))).when(k == 1, many).when(k == 2, "null")
    return t.part.select("p_partkey", F.array_join(c.name_list(raw), "|").alias("authors"))


@query(
    "n37_vocabulary",
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN o_orderpriority ELSE '3-MEDIUM' END AS priority FROM orders",
)
def n37(t):
    return t.orders.select("o_orderkey", c.in_vocabulary("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "3-MEDIUM").alias("priority"))
