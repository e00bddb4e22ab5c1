"""Queries of table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.columns import GENDERS
from folio.operators import maintain as m
from folio.plans.registry import query
from folio.sources.shared import shared_path
from folio.sources.snapshots import Store

S = lambda c: F.col(c).cast("string")


@query(
    "m1_upsert",
    """SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NOT NULL THEN CASE WHEN n.k % 4 = 0 THEN NULL ELSE 'SEG' END ELSE c_mktsegment END AS c_mktsegment, c_acctbal
    FROM customer c FULL JOIN (SELECT c_custkey * 2 AS k FROM customer WHERE c_custkey % 3 = 0) n ON n.k = c.c_custkey""",
)
def m1(t):
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("c_custkey") * 2
    new = t.customer.where("c_custkey % 3 = 0").select(key.alias("c_custkey"), F.when(key % 4 != 0, "SEG").alias("c_mktsegment"))
    return m.upsert(base, new, "c_custkey", ["c_mktsegment"])


@query(
    "m2_insert_absent",
    """SELECT o_custkey + 1000 AS c_custkey, min(o_orderkey) AS first_order, o_custkey + 1000 IN (SELECT c_custkey FROM customer) AS existed FROM orders GROUP BY o_custkey""",
)
def m2(t):
    rows = t.orders.select((F.col("o_custkey") + 1000).alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    new, old = m.insert_absent(t.customer, rows, "c_custkey", ["first_order"])
    return new.withColumn("existed", F.lit(False)).unionByName(old.withColumn("existed", F.lit(True)))


@query(
    "m3_audit_rows",
    """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders)
    SELECT 'book' AS entity_type, entity_id, 'status' AS field, '"' || s || '"' AS old_value, CASE WHEN k % 10 = 0 THEN 'null' ELSE '"X"' END AS new_value FROM d WHERE k % 5 = 0
    UNION ALL SELECT 'book', entity_id, 'validated', CASE WHEN s = 'F' THEN 'true' ELSE 'false' END, 'true' FROM d WHERE s <> 'F'
    UNION ALL SELECT 'book', entity_id, 'owner', CAST(c AS VARCHAR), CAST(c + 1 AS VARCHAR) FROM d WHERE k % 3 = 0""",
)
def m3(t):
    k = F.col("o_orderkey")
    before = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("validated"), F.col("o_custkey").alias("owner"))
    after = before.withColumns(
        {
            "status": F.when(k % 10 == 0, None).when(k % 5 == 0, "X").otherwise(F.col("status")),
            "validated": F.lit(True),
            "owner": F.when(k % 3 == 0, F.col("owner") + 1).otherwise(F.col("owner")),
        }
    )
    return m.audit_rows(before, after, "o_orderkey", ["status", "validated", "owner"], "book")


_RENAMES = """WITH r AS (SELECT 'b' || CAST(o_orderkey AS VARCHAR) AS old, CASE o_orderkey % 30 WHEN 0 THEN 'b' || CAST(o_orderkey AS VARCHAR) WHEN 10 THEN 'b1'
  ELSE 'new' || CAST(o_orderkey AS VARCHAR) END AS new, o_orderkey AS k FROM orders WHERE o_orderkey % 10 = 0),
b AS (SELECT 'b' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT old, new, CASE WHEN old = new THEN 'same id' WHEN old NOT IN (SELECT id FROM b) THEN 'source missing' WHEN new IN (SELECT id FROM b) THEN 'target exists' END AS refused FROM r) """


def renames(t):
    k = F.col("o_orderkey")
    old = F.concat(F.lit("b"), S("o_orderkey"))
    new = F.when(k % 30 == 0, old).when(k % 30 == 10, "b1").otherwise(F.concat(F.lit("new"), S("o_orderkey")))
    books = t.orders.where("o_orderstatus != 'P'").select(old.alias("id"))
    return m.rename_plan(t.orders.where("o_orderkey % 10 = 0").select(old.alias("old"), new.alias("new")), books)


@query("m4_rename_plan", _RENAMES + "SELECT old, new, refused FROM p")
def m4(t):
    return renames(t)


@query(
    "m4_rename_children",
    _RENAMES
    + """SELECT coalesce(p.new, 'b' || CAST(l_orderkey AS VARCHAR)) || '_' || CAST(l_linenumber AS VARCHAR) AS id, coalesce(p.new, 'b' || CAST(l_orderkey AS VARCHAR)) AS book, l_partkey
    FROM lineitem LEFT JOIN p ON p.old = 'b' || CAST(l_orderkey AS VARCHAR) AND refused IS NULL""",
)
def m4_children(t):
    book = F.concat(F.lit("b"), S("l_orderkey"))
    pages = t.lineitem.select(F.concat_ws("_", book, S("l_linenumber")).alias("id"), book.alias("book"), "l_partkey")
    return m.rename_children(pages, "id", "book", renames(t))


_LISTS = _RENAMES + """, l AS (SELECT 'b' || CAST(l_orderkey AS VARCHAR) AS book, 'b' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS id, l_linenumber AS n FROM lineitem),
o AS (SELECT 'b' || CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P') """


@query(
    "m4_rename_books",
    _LISTS
    + """, c AS (SELECT book, string_agg(coalesce(new, book) || substring(id, length(book) + 1), ',' ORDER BY coalesce(new, book) || substring(id, length(book) + 1)) AS people
      FROM l LEFT JOIN p ON p.old = book AND refused IS NULL GROUP BY 1)
    SELECT coalesce(new, o.id) AS id, CASE WHEN new IS NULL THEN 'T ' || o.id ELSE 'N ' || o.id END AS title, CASE WHEN new IS NULL THEN 'scans/T ' || o.id ELSE 'scans/N ' || o.id END AS photos_url,
      CASE WHEN new IS NULL THEN 'kept' ELSE coalesce(people, '') END AS characters, s AS status
    FROM o LEFT JOIN p ON p.old = o.id AND refused IS NULL LEFT JOIN c ON c.book = o.id""",
)
def m4_books(t):
    book, old = F.concat(F.lit("b"), S("l_orderkey")), F.concat(F.lit("b"), S("o_orderkey"))
    title = F.concat(F.lit("T "), old)
    books = t.orders.where("o_orderstatus != 'P'").select(
        old.alias("id"), title.alias("title"), F.concat(F.lit("scans/"), title).alias("photos_url"), F.array(F.lit("kept")).alias("characters"), F.col("o_orderstatus").alias("status")
    )
    people = t.lineitem.select(F.concat_ws("_", book, S("l_linenumber")).alias("id"), book.alias("book"))
    titles = books.select("id", F.concat(F.lit("N "), "id").alias("title"))
    return m.rename_books(books, people, titles, renames(t)).withColumn("characters", F.array_join("characters", ","))


@query(
    "m4_rename_references",
    _LISTS
    + """SELECT book || '/' || CAST(n AS VARCHAR) AS alias, CASE WHEN n = 1 THEN 'x' || id WHEN new IS NULL THEN id ELSE new || substring(id, length(book) + 1) END AS character
    FROM l LEFT JOIN p ON p.old = book AND refused IS NULL""",
)
def m4_references(t):
    book, n = F.concat(F.lit("b"), S("l_orderkey")), S("l_linenumber")
    # references that lead to no child of the book stay as they are
    who = F.concat(F.when(F.col("l_linenumber") == 1, "x").otherwise(""), F.concat_ws("_", book, n))
    aliases = t.lineitem.select(F.concat_ws("/", book, n).alias("alias"), who.alias("character"), book.alias("book"))
    return m.rename_references(aliases, "character", "book", renames(t)).drop("book")


def _people(t):
    book = (F.col("p_partkey") % 50).cast("string")
    name = F.concat(F.lit("Ann "), S("p_partkey"))
    return t.part.select(F.concat_ws("_", book, F.lower(F.translate(name, " ", "_"))).alias("id"), book.alias("book"), name.alias("name"), "p_partkey")


_RENAMED = """WITH c AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS book, p_partkey AS k, 'Ann ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_partkey % 50 AS VARCHAR) || '_ann_' || CAST(p_partkey AS VARCHAR) AS id FROM part),
a AS (SELECT *, CASE k % 7 WHEN 0 THEN 'ANN ' || CAST(k AS VARCHAR) WHEN 1 THEN 'Bob ' || CAST(k AS VARCHAR) WHEN 2 THEN 'Ann ' || CAST((k + 50) % 1000 AS VARCHAR) END AS asked FROM c),
n AS (SELECT *, book || '_' || lower(replace(asked, ' ', '_')) AS new_id FROM a WHERE asked IS NOT NULL),
g AS (SELECT id, new_id, asked, book FROM n WHERE new_id = id OR new_id NOT IN (SELECT id FROM c) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY id) = 1) """


def _renamed(t):
    people = _people(t)
    k = F.col("p_partkey") % 7
    # a change of case, a new name, and a name that the book may have already
    new = F.when(k == 0, F.upper("name")).when(k == 1, F.replace(F.col("name"), F.lit("Ann"), F.lit("Bob")))
    new = new.when(k == 2, F.concat(F.lit("Ann "), ((F.col("p_partkey") + 50) % F.lit(1000)).cast("string")))
    names = people.where(k < 3).select("id", new.alias("new_name"))
    aliases = people.select(S("p_partkey").alias("aid"), F.col("id").alias("character")).withColumnRenamed("aid", "id")
    books = people.groupBy(F.col("book").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("characters"))
    return m.rename_characters(people.select("id", "book", "name"), names, aliases, books)


@query(
    "m5_rename_characters",
    _RENAMED
    + """SELECT 'character' AS kind, coalesce(g.new_id, c.id) AS id, coalesce(g.asked, c.name) AS name FROM c LEFT JOIN g ON g.id = c.id
    UNION ALL SELECT 'alias', CAST(k AS VARCHAR), coalesce(g.new_id, c.id) FROM c LEFT JOIN g ON g.id = c.id""",
)
def m5(t):
    chars, moved, _ = _renamed(t)
    out = chars.select(F.lit("character").alias("kind"), "id", "name")
    return out.unionByName(moved.select(F.lit("alias").alias("kind"), "id", F.col("character").alias("name")))


@query(
    "m5_character_lists",
    _RENAMED
    + """, s AS (SELECT c.book, c.id, g.new_id FROM c LEFT JOIN g ON g.id = c.id AND g.new_id <> g.id)
    SELECT book AS id, string_agg(coalesce(new_id, id), ',' ORDER BY new_id IS NOT NULL, id) AS characters FROM s GROUP BY 1""",
)
def m5_lists(t):
    return _renamed(t)[2].select("id", F.array_join("characters", ",").alias("characters"))


@query(
    "m6_delete_plan",
    """WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS book FROM orders WHERE o_orderkey % 100 = 0),
    l AS (SELECT CAST(l_orderkey AS VARCHAR) AS book, l_orderkey AS o, l_linenumber AS n FROM lineitem)
    SELECT 'books' AS collection, book AS path FROM b
    UNION SELECT 'pages', book || '_p' || CAST(n AS VARCHAR) FROM l WHERE book IN (SELECT book FROM b)
    UNION SELECT 'characters', book || '_c' || CAST(n AS VARCHAR) FROM l WHERE book IN (SELECT book FROM b)
    UNION SELECT 'aliases', 'a' || CAST(o AS VARCHAR) || '_' || CAST(n AS VARCHAR) FROM l WHERE CAST(o + 1 AS VARCHAR) IN (SELECT book FROM b) OR book IN (SELECT book FROM b)
    UNION SELECT 'files', 'f' || book FROM l WHERE book IN (SELECT book FROM b)""",
)
def m6(t):
    books = t.orders.where("o_orderkey % 100 = 0").select(S("o_orderkey").alias("book"))
    n, book = S("l_linenumber"), S("l_orderkey")
    lines = t.lineitem
    pages = lines.select(F.concat(book, F.lit("_p"), n).alias("id"), book.alias("book"))
    people = lines.select(F.concat(book, F.lit("_c"), n).alias("id"), book.alias("book"))
    after = (F.col("l_orderkey") + 1).cast("string")
    # an alias names a character of its own book, and belongs to the book after it
    aliases = lines.select(F.concat(F.lit("a"), book, F.lit("_"), n).alias("id"), after.alias("book"), F.concat(book, F.lit("_c"), n).alias("character"))
    files = lines.select(F.concat(F.lit("f"), book).alias("id"), book.alias("book"))
    return m.delete_plan(books, pages, people, aliases, files)


@query(
    "m6_deletable_people",
    """SELECT c_custkey, coalesce(n, 0) AS uses, n IS NULL AS deleted FROM customer LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY k) ON k = c_custkey""",
)
def m6_people(t):
    books = t.orders.select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("author"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).alias("illustrator"))
    return m.deletable_people(t.customer, "c_custkey", books, ["author", "illustrator"])


@query(
    "m6_protected",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'users' WHEN 2 THEN 'collections' WHEN 3 THEN 'edit_log' WHEN 4 THEN 'extraction_errors' WHEN 5 THEN 'books' ELSE 'pages' END AS collection,
    l_linenumber <= 4 AS refused FROM lineitem""",
)
def m6_protected(t):
    k = F.col("l_linenumber")
    name = F.when(k == 1, "users").when(k == 2, "collections").when(k == 3, "edit_log").when(k == 4, "extraction_errors").when(k == 5, "books").otherwise("pages")
    asked = t.lineitem.select("l_orderkey", "l_linenumber", name.alias("collection"))
    return asked.withColumn("refused", m.protected("collection"))


_PAGES = "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"


@query(
    "m7_reordered",
    f"""WITH l AS ({_PAGES}), b AS (SELECT l_orderkey, count(*) AS k, max(l_linenumber) AS hi FROM l GROUP BY 1),
    g AS (SELECT *, 1 + l_orderkey % 3 AS src, 1 + l_orderkey % 2 AS dst, k = hi AND 1 + l_orderkey % 3 <= k AND 1 + l_orderkey % 2 <= k AS good FROM b)
    SELECT l_orderkey, l_linenumber, NOT good AS refused, CAST(CASE WHEN NOT good THEN l_linenumber WHEN l_linenumber = src THEN dst
      WHEN l_linenumber > src AND l_linenumber <= dst THEN l_linenumber - 1 WHEN l_linenumber < src AND l_linenumber >= dst THEN l_linenumber + 1 ELSE l_linenumber END AS BIGINT) AS new_page
    FROM l JOIN g USING (l_orderkey)""",
)
def m7(t):
    pages = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    moves = pages.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    moves = moves.withColumns({"source": 1 + F.col("l_orderkey") % 3, "target": 1 + F.col("l_orderkey") % 2})
    return m.reordered(pages, "l_orderkey", "l_linenumber", moves).withColumn("new_page", F.col("new_page").cast("long"))


@query(
    "m8_file_moves",
    """WITH v AS (SELECT DISTINCT l_orderkey AS folder, l_linenumber AS page, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_cropped' ELSE '_display' END AS variant FROM lineitem),
    g AS (SELECT folder, old, 3 - old AS new, variant FROM (SELECT DISTINCT folder FROM v), (VALUES (1), (2)) o(old), (VALUES (''), ('_cropped'), ('_display')) x(variant)),
    j AS (SELECT g.*, a.page IS NOT NULL AS f, b.page IS NOT NULL AS t FROM g LEFT JOIN v a ON a.folder = g.folder AND a.page = old AND a.variant = g.variant
      LEFT JOIN v b ON b.folder = g.folder AND b.page = new AND b.variant = g.variant)
    SELECT folder, CASE WHEN f THEN 'move' ELSE 'delete' END AS action, CASE WHEN f THEN 'page_' || CAST(old AS VARCHAR) || variant || '.jpg' END AS old,
    'page_' || CAST(new AS VARCHAR) || variant || '.jpg' AS new FROM j WHERE f OR t""",
)
def m8(t):
    k = F.col("l_partkey") % 3
    variant = F.when(k == 0, "").when(k == 1, "_cropped").otherwise("_display")
    inventory = t.lineitem.select(F.col("l_orderkey").alias("folder"), F.col("l_linenumber").alias("page"), variant.alias("variant"))
    swaps = inventory.select("folder").distinct().withColumn("old", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("new", 3 - F.col("old"))
    return m.file_moves(inventory, swaps, ["", "_cropped", "_display"])


@query(
    "m9_pending_writes",
    """WITH s AS (SELECT o_orderkey, o_custkey % 2 AS token FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_orderkey, 1 AS token FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(s.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'clear' WHEN s.token = c.token THEN 'finish' ELSE 'discard' END AS action
    FROM s FULL JOIN c ON s.o_orderkey = c.o_orderkey""",
)
def m9(t):
    staged = t.orders.where("o_orderkey % 3 != 0").select("o_orderkey", (F.col("o_custkey") % 2).alias("token"))
    return m.pending_writes(staged, t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(1).cast("long").alias("token")), "o_orderkey")


@query(
    "m9_resumed",
    """WITH n AS (SELECT o_orderkey AS id, o_custkey % 7 AS page FROM orders)
    SELECT 'books' AS "table", id, 'first' AS state FROM n UNION ALL SELECT 'pages', id, 'third' FROM n WHERE page <> 0""",
)
def m9_resumed(t):
    """Four writes of two tables: a whole one, one that stops before its pointer, one that stops after it, one that stops
    while staging; then what a resumed store shows."""
    store = Store(t.spark, shared_path(t.spark, "resumed"))
    rows = lambda state: t.orders.select(F.col("o_orderkey").alias("id"), F.lit(state).alias("state"))
    both = lambda state: {"pages": rows(state), "books": rows(state)}
    store.write(both("first"), "edit", 0)
    store.stage(both("second"), "edit", 1)
    kept = t.orders.where("o_custkey % 7 != 0").select(F.col("o_orderkey").alias("id"), F.lit("third").alias("state"))
    _stopped(store, "clear", lambda: store.write({"pages": kept}, "edit", 2))
    _stopped(store, "manifest", lambda: store.write(both("fourth"), "edit", 3))
    store.resume()
    read = lambda name: store.read(name).select(F.lit(name).alias("table"), "id", "state")
    return read("books").unionByName(read("pages"))


class _Stop(Exception):
    pass


def _stopped(store: Store, before: str, write) -> None:
    """Run a write that stops before a step."""

    def do(what, action, *args):
        if what == before:
            raise _Stop
        return action(*args)

    store._do = do
    try:
        write()
    except _Stop:
        pass
    del store._do


def _suggested(t):
    k, part = F.col("l_partkey"), S("l_partkey")
    line = F.col("l_linenumber")
    action = F.when(line % 4 == 0, "skip").when(line % 4 == 3, "merge").otherwise("create")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(
        S("l_orderkey").alias("book"),
        line.alias("pos"),
        F.concat(F.lit("Cat "), (k % 9).cast("string")).alias("name"),
        action.alias("action"),
        F.when(line % 4 == 3, F.concat(F.lit("Cat "), (k % 5).cast("string"))).alias("target"),
        F.array(F.concat(F.lit("Puss "), part), F.lit(" ")).alias("aliases"),
    )


_SUGGESTED = """WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS book, l_linenumber AS pos, 'Cat ' || CAST(min(l_partkey) % 9 AS VARCHAR) AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'skip' WHEN 3 THEN 'merge' ELSE 'create' END AS action, CASE WHEN l_linenumber % 4 = 3 THEN 'Cat ' || CAST(min(l_partkey) % 5 AS VARCHAR) END AS target,
  'Puss ' || CAST(min(l_partkey) AS VARCHAR) AS alias FROM lineitem GROUP BY l_orderkey, l_linenumber),
i AS (SELECT *, book || '_' || lower(replace(name, ' ', '_')) AS id, book || '_' || lower(replace(coalesce(target, name), ' ', '_')) AS ch FROM s WHERE action <> 'skip'),
have AS (SELECT CAST(o_orderkey AS VARCHAR) || '_cat_1' AS id FROM orders),
n AS (SELECT id, book, name FROM i WHERE action = 'create' AND id NOT IN (SELECT id FROM have) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
known AS (SELECT id FROM have UNION SELECT id FROM i WHERE action = 'create'),
a AS (SELECT book, ch, pos, name AS al FROM i WHERE action = 'merge' AND ch IN (SELECT id FROM known) UNION ALL SELECT book, ch, pos, alias FROM i WHERE ch IN (SELECT id FROM known)),
f AS (SELECT book || '_' || lower(replace(al, ' ', '_')) AS id, book, ch, al FROM a QUALIFY row_number() OVER (PARTITION BY book || '_' || lower(replace(al, ' ', '_')) ORDER BY pos, ch, al) = 1)
"""


@query(
    "m10_commit_characters",
    _SUGGESTED
    + """SELECT 'character' AS kind, id, name, NULL AS character FROM n UNION ALL SELECT 'alias', id, al, ch FROM f WHERE id NOT IN (SELECT CAST(p_partkey AS VARCHAR) || '_puss_' || CAST(p_partkey AS VARCHAR) FROM part)
    UNION ALL SELECT 'unresolved', book, name, target FROM i WHERE ch NOT IN (SELECT id FROM known)""",
)
def m10(t):
    characters = t.orders.select(F.concat(S("o_orderkey"), F.lit("_cat_1")).alias("id"))
    aliases = t.part.select(F.concat(S("p_partkey"), F.lit("_puss_"), S("p_partkey")).alias("id"))
    new, names, lost = m.commit_characters(_suggested(t), characters, aliases)
    none = F.lit(None).cast("string")
    out = new.select(F.lit("character").alias("kind"), "id", "name", none.alias("character"))
    out = out.unionByName(names.select(F.lit("alias").alias("kind"), "id", "name", "character"))
    return out.unionByName(lost.select(F.lit("unresolved").alias("kind"), F.col("book").alias("id"), "name", F.col("target").alias("character")))


@query(
    "m11_clean_suggestions",
    """SELECT conv_id, turn, role AS name, CASE WHEN turn % 2 = 0 THEN 'Female' ELSE 'Non-specific' END AS gender, true AS human, turn % 3 = 0 AS plural,
    CASE WHEN role = 'user' THEN 'Narrator' || CASE WHEN turn % 2 = 0 THEN '|mum' ELSE '' END ELSE 'USER|Narrator' || CASE WHEN turn % 2 = 0 THEN '|mum' ELSE '' END END AS aliases
    FROM conversations WHERE turn % 5 <> 4""",
)
def m11(t):
    turn = F.col("turn")
    rows = t.conversations.select(
        "conv_id",
        turn.alias("pos"),
        F.when(turn % 5 != 4, F.concat(F.col("role"), F.lit(" "))).otherwise("  ").alias("name"),
        F.when(turn % 2 == 0, "Female").otherwise("robot").alias("gender"),
        F.lit(None).cast("boolean").alias("human"),
        F.when(turn % 3 == 0, True).alias("plural"),
        F.lit(None).cast("boolean").alias("protagonist"),
        F.array(F.lit(" USER "), F.lit("the Narrator"), F.lit("NARRATOR"), F.when(turn % 2 == 0, "my mum").otherwise(" ")).alias("aliases"),
    )
    out = m.clean_suggestions(rows, "conv_id", GENDERS, "Non-specific")
    return out.select("conv_id", F.col("pos").alias("turn"), "name", "gender", "human", "plural", F.array_join("aliases", "|").alias("aliases"))


@query(
    "m13_folder_moves",
    r"""WITH f AS (SELECT url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS old FROM pages)
    SELECT url AS old_path, 's3:/moved/' || regexp_extract(old, '//(.*)$', 1) || substring(url, length(old) + 1) AS new_path FROM f WHERE old LIKE '%/en' AND old LIKE 'https%'""",
)
def m13(t):
    folders = t.pages.select(F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("old")).distinct().where("old LIKE '%/en'")
    new = F.when(F.startswith("old", F.lit("https")), F.concat(F.lit("s3:/moved/"), F.regexp_extract("old", "//(.*)$", 1))).otherwise(F.col("old"))
    return m.folder_moves(t.pages.select("url"), "url", folders.select("old", new.alias("new")))


@query(
    "m14_complete_pages",
    """WITH g AS (SELECT o_orderkey, CAST(unnest(range(1, 1 + o_custkey % 4)) AS INTEGER) AS page FROM orders),
    r AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS ok, CAST(min(l_partkey) AS VARCHAR) AS text FROM lineitem GROUP BY 1, 2)
    SELECT o_orderkey, page, CASE WHEN ok THEN 'done' WHEN ok IS NOT NULL THEN 'failed' ELSE 'missing' END AS outcome, CASE WHEN ok THEN text ELSE '' END AS text,
    CASE WHEN ok THEN false END AS corrected, CASE WHEN ok THEN NULL WHEN ok IS NULL THEN 'no result' ELSE 'bad' END AS error_message
    FROM g LEFT JOIN r ON l_orderkey = o_orderkey AND l_linenumber = page""",
)
def m14(t):
    jobs = t.orders.select("o_orderkey", (F.col("o_custkey") % 4).alias("n"))
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("ok"), F.min("l_partkey").cast("string").alias("text"), F.lit("bad").alias("error")
    )
    pages, errors = m.complete_pages(jobs, "o_orderkey", "n", results, "page")
    return pages.join(errors, ["o_orderkey", "page"], "left")
