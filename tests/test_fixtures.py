"""Hand-worked answers for columns, joins, aggregations, windows and maintenance."""

import random
from difflib import SequenceMatcher, get_close_matches

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import columns as c
from folio.functions import replies as r
from folio.functions.matching import ratios
from folio.operators import aggs as g
from folio.operators import joins as j
from folio.operators import maintain as m
from folio.operators import ordering as o
from folio.operators import windows as w
from folio.plans import QUERIES
from folio.sources import tables as s
from folio.sources.snapshots import Store


def values(spark, expr, cases, kind="string"):
    rows = [(i, x) for i, x in enumerate(cases)]
    out = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr.alias("y")).collect()
    return [q.y for q in sorted(out)]


def test_junk_names(spark):
    junk = ["test", "  ", "asdf", "aaaa", "....", "12345", "x", "Test Book", "qwer", "zxcvb", "poiu tre", None, "lkjh"]
    real = ["Li", "Julia Donaldson", "A A Milne", "aa milne", "Ng", "The Gruffalo", "Book of Hours"]
    assert all(values(spark, c.junk_reason("x"), junk))
    assert not any(values(spark, c.junk_reason("x"), real))


def test_titles_names_years(spark):
    assert values(spark, c.normal_title("x"), ["Tom & Jerry!", " Café  2 ", None, "A–B"]) == ["tom and jerry", "caf 2", "", "a b"]
    assert values(spark, c.without_article("x"), ["the Butterfly", "My mum", "the", "Theo", " a  the b"]) == ["Butterfly", "mum", "the", "Theo", "the b"]
    names = values(spark, c.split_name("x"), ["Julia Donaldson", "Madonna", "  ", None, "J. R. R.  Tolkien"])
    assert [tuple(n) for n in names] == [("Julia", "Donaldson"), ("Madonna", ""), ("", ""), ("", ""), ("J. R. R.", "Tolkien")]
    assert values(spark, c.year_of("x", 2025), ["c1999", "1899", "20260", "99", None, "2025-01"]) == [1999, None, None, None, None, 2025]
    isbns = values(spark, c.isbn("x"), ["ISBN 978-0-14-044913-6", "0 330 25864 8 x", "none", None, "080442957X"])
    assert isbns == ["9780140449136", "0330258648", None, None, "080442957X"]
    assert values(spark, c.is_email("x"), ["a@b.co", "a@b", "@b.co", "a b@c.de", None]) == [True, False, False, False, False]
    assert values(spark, c.blank_text("x"), ['""', "<br>", "<b>é</b>", None]) == ["", "", "<b>é</b>", ""]


def test_author_field(spark):
    rows = [("Michael Rosen and Helen Oxenbury", "M/F"), ("Janet and Allen Ahlberg", "F/M"), ("A B and C D and E F", "M/F/M"), ("Solo Name", "F"), (None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, g string")
    got = [tuple(q.y) for q in df.select("i", c.author_field("a", "g").alias("y")).orderBy("i").collect()]
    assert got == [
        ("Michael Rosen", "M", "Helen Oxenbury", False),
        ("", "", "Allen Ahlberg", True),
        ("A B and C D and E F", "", "", True),
        ("Solo Name", "F", "", False),
        ("", "", "", False),
    ]


def test_word_multisets(spark):
    pairs = [(0, "a b c", "A, b. c!"), (1, "", ""), (2, "x", ""), (3, "", "x"), (4, "the cat sat", "the cat"), (5, "a a b", "a b b"), (6, None, None)]
    got = {q.k: (q.jaccard, q.containment) for q in g.overlap(spark.createDataFrame(pairs, "k int, l string, r string"), ["k"], "l", "r").collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (2 / 3, 1), 5: (0.5, 2 / 3), 6: (1, 1)}
    texts = [(0, "a b c", "a c"), (1, "a b", "a b d"), (2, "Cat", "cat"), (3, "a", " "), (4, "a a", "a a a"), (5, "x", None)]
    kept = {q.k: q.kept for q in g.only_removed(spark.createDataFrame(texts, "k int, l string, r string"), "l", "r").collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_review_verdict_table(spark):
    cases = [(a, b, t) for a in (True, False) for b in (True, False) for t in (True, False)]
    df = spark.createDataFrame(cases, "a boolean, b boolean, t boolean").select("*", c.review_verdict("a", "b", "t").alias("v"))
    for q in df.collect():
        want = (False, "") if q.a and q.b else (True, "high") if (not q.b and (not q.a or not q.t)) else (True, "normal")
        assert tuple(q.v) == want


def test_fuzzy_match_is_difflib(spark):
    rng = random.Random(5)
    options = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["tide", "diet", "Ab"]
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 9))) for _ in range(80)] + ["diet", "tide", "axb", "ab"]
    names = [n for n in names if n.strip()]
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = {q.name: q.match for q in j.fuzzy_match(one(names), "x", one(options), "x").collect()}
    spelled = {}
    for x in sorted(options):
        spelled.setdefault(x.lower(), x)
    for n in names:
        best = get_close_matches(n.strip().lower(), list(spelled), n=1, cutoff=0.8)
        assert got[n] == (spelled[best[0]] if best else None), n


def test_unique_titles_is_greedy(spark):
    rng = random.Random(6)
    titles = [rng.choice(["Cat", "cat", "Cat (2)", "Dog", None, " ", "Dog (3)"]) for _ in range(60)]
    have = ["cat", "dog_(2)"]
    df = spark.createDataFrame(list(enumerate(titles)), "pos int, t string")
    got = {q.position: q.id for q in w.unique_titles(df, "t", "pos", spark.createDataFrame([(h,) for h in have], "id string"), "id").collect()}
    taken = set(have)
    for i, t in enumerate(titles):
        if not (t or "").strip():
            # of the batch, one id is used by each title before
            t = f"Untitled book {i + 1}"
        n, name = 1, t.strip()
        while (key := name.lower().replace(" ", "_")) in taken:
            n += 1
            name = f"{t.strip()} ({n})"
        taken.add(key)
        assert got[i] == key


def greedy_titles(titles, have):
    taken, out = set(have), []
    for i, t in enumerate(titles):
        t = (t or "").strip() or f"Untitled book {i + 1}"
        n, name = 1, t
        while (key := name.lower().replace(" ", "_")) in taken:
            n += 1
            name = f"{t} ({n})"
        taken.add(key)
        out.append((i, name, key))
    return out


@pytest.mark.parametrize("seed,piece", [(1, 10**6), (2, 7), (3, 5), (4, 3)])
def test_unique_titles_across_titles(spark, monkeypatch, seed, piece):
    """Titles that clash with other titles' numbers, at two levels, with gaps in what is taken; in large and tiny pieces."""
    monkeypatch.setattr(w, "PIECE", piece)
    rng = random.Random(seed)
    kinds = ["Cat", "cat", "Cat (2)", "CAT (3)", "cat (4)", "Cat (2) (2)", "cat (2) (3)", "Cat (02)", "Cat (1)", "Cat (7)", "Dog", "dog (5)", "", None, "Untitled book 9", "Eel (2)"]
    titles = [rng.choice(kinds) for _ in range(150)]
    have = rng.sample(["cat", "cat_(5)", "cat_(6)", "cat_(9)", "dog_(2)", "dog_(3)", "cat_(2)_(2)", "eel", "cat_(3)", "untitled_book_9_(2)", "owl"], 6)
    df = spark.createDataFrame(list(enumerate(titles)), "pos int, t string").repartition(3)
    got = w.unique_titles(df, "t", "pos", spark.createDataFrame([(h,) for h in have], "id string"), "id").collect()
    assert sorted(map(tuple, got)) == greedy_titles(titles, have)


def test_a_hundred_thousand_equal_titles(spark):
    """Copies are ranked, not tried one by one."""
    df = spark.range(100_000).select(F.col("id").alias("pos"), F.lit("Same").alias("t"))
    have = spark.createDataFrame([("same",), ("same_(10)",), ("same_(11)",)], "id string")
    got = w.unique_titles(df, "t", "pos", have, "id").agg(F.count_distinct("id").alias("n"), F.max(F.regexp_extract("id", "([0-9]+)", 1).cast("int")).alias("top")).first()
    assert tuple(got) == (100_000, 100_003)


def test_matching_ratio_is_difflib():
    rng = random.Random(8)
    name = lambda letters, lo, hi: "".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi)))
    pairs = [(name("abc d", 0, 14), name("abc dé漢", 0, 14)) for _ in range(2000)] + [(name("ab c", 180, 260), name("ab c", 180, 260)) for _ in range(20)]
    pairs += [("", ""), ("", "a"), ("a", ""), ("\U0001f600x", "x\U0001f600")]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    first, second = zip(*pairs)
    assert ratios(list(first), list(second)).tolist() == want
    assert ratios(list(first), list(second), 0.6).tolist() == [x if x >= 0.6 else 0 for x in want]


def test_gaps_are_ranges(spark, monkeypatch):
    rows = [(1, 3), (1, 3), (1, 2_000_000_000), (2, 1), (2, 2), (3, 0), (3, -5), (4, 2), (4, 5), (4, None), (None, 2)]
    df = spark.createDataFrame(rows, "s int, n int")
    ranges = sorted(map(tuple, o.missing_ranges(df, "s", "n").collect()), key=str)
    assert ranges == sorted([(1, 1, 2), (1, 4, 1_999_999_999), (4, 1, 1), (4, 3, 4), (None, 1, 1)], key=str)
    monkeypatch.setattr(o, "PIECE", 3)
    monkeypatch.setattr(o, "STEP", 2)
    rng = random.Random(4)
    rows = [(s, rng.randrange(1, 40)) for s in range(4) for _ in range(12)]
    got = sorted(map(tuple, o.missing_slots(spark.createDataFrame(rows, "s int, n int"), "s", "n").collect()))
    have = {s: {n for x, n in rows if x == s} for s in range(4)}
    assert got == [(s, n) for s in range(4) for n in range(1, max(have[s])) if n not in have[s]]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(7, "b", 1), (8, "a", 2)], "_id int, s string, _o0 int")
    assert [tuple(r) for r in o.numbered(df, [F.col("s")]).orderBy("place").collect()] == [(8, "a", 2, 1), (7, "b", 1, 2)]
    df = spark.createDataFrame([("a b", "a", 1, 2, 3)], "l string, r string, _l int, _r int, _common int")
    assert g.only_removed(df, "l", "r").first().asDict() == {"l": "a b", "r": "a", "_l": 1, "_r": 2, "_common": 3, "kept": True}


def test_a_result_is_scored_once(spark, tmp_path):
    """A scorer that counts its calls: one a key, whatever frames are written, jobs run again, or stopped before they commit."""
    store = Store(spark, f"file://{tmp_path}/store")
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        if text.startswith("bad"):
            raise ValueError(text)
        return len(text)

    def scorer(misses):
        return r.scored(misses, "key", "text", count).withColumn("ok", F.col("error").isNull())

    docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(12)] + [(20, "bad"), (21, None)], "id int, text string")
    ask = lambda n, df=docs: {q.id: (q.score, q.cached) for q in j.score_once(df, ["text"], store, "scores", scorer, "score double", "job", n).collect()}
    first = ask(0)
    assert first[0] == (6.0, False) and first[20] == (None, False) and calls.value == 6
    again = ask(0)  # the same job: only its failures are tried again
    assert again[0] == (6.0, True) and calls.value == 8
    more = docs.unionByName(spark.createDataFrame([(30, "longer text")], "id int, text string"))
    stop = store.write
    store.write = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        ask(1, more)
    store.write, made = stop, calls.value
    assert ask(1, more)[30] == (11.0, False) and calls.value == made  # its results stood written
    assert {q.score for q in store.read("scores").collect()} == {6.0, 11.0} and store.read("scores").count() == 5


def test_records_are_appended_once(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(s, "MOST_FOLDERS", 3)
    rows = spark.createDataFrame([(1, "2025-01-02 03:04:05", True)], "id int, t string, v boolean").withColumn("t", F.col("t").cast("timestamp"))
    for number in (0, 1, 1, 0, 2, 3, 4, 4):
        s.append_once(rows, store, "log", "t", ["v"], "daily", number)
    assert [tuple(q) for q in store.read("log").select("id", "day", "v").collect()] == [(1, "2025-01-02", '{"v":true}')] * 5
    assert len(store.pointer()["tables"]["log"]["folders"]) <= 3


def test_guard_between_tiers(spark):
    rows = [(1, "a b c"), (2, "a b"), (3, "boom"), (4, None), (5, "keep")]
    df = spark.createDataFrame(rows, "k int, t string")

    def cheap(text):
        if text == "boom":
            raise ValueError("no")
        return {"a b c": "a c", "a b": "a b new", "keep": " "}[text]

    got = {q.key: (q.cleaned, q.tier, q.kept) for q in r.cleaned_in_two_tiers(df, "k", "t", cheap, lambda t: t.upper()).collect()}
    assert got == {"1": ("a c", 1, True), "2": ("A B", 2, False), "3": ("BOOM", 2, False), "4": (None, 2, False), "5": ("KEEP", 2, False)}


def test_database_table_in_ranges(spark, tmp_path):
    """A bundled engine's table: ranges of the key are partitions, filters and columns go to the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    base = spark.range(100).select("id", (F.col("id") % 7).cast("int").alias("n"), F.concat(F.lit("b"), "id").alias("name"))
    base.write.format("jdbc").options(url=url, dbtable="books", driver=DERBY).save()
    df = s.database_table(spark, url, "books", "id", 4, driver=DERBY)
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == sorted(map(tuple, base.collect()))
    some = df.where("n = 3").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo" in plan and "name" not in plan.lower()
    assert {q.id for q in some.collect()} == {i for i in range(100) if i % 7 == 3}
    characters, _, odd = s.character_source(
        s.database_table(spark, url, "books", "id", driver=DERBY).select(F.col("name").alias("book"), "name", F.lit("H").alias("human")), spark.createDataFrame([("b1", "x")], "book string, alias string")
    )
    assert characters.count() == 100 and odd.count() == 0
    spark.createDataFrame([], "id long").write.format("jdbc").options(url=url, dbtable="no_books", driver=DERBY).save()
    assert s.database_table(spark, url, "no_books", "id", driver=DERBY).count() == 0


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def test_listing_of_objects(spark, tmp_path):
    for path, size in (("a/page_1.jpg", 3), ("a/page_2_cropped.jpg", 30), ("b/sub/page_3.jpg", 300), ("b/notes.txt", 5), ("uploads/page_4.jpg", 1)):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    files = s.listing(spark, f"file://{tmp_path}", "*.jpg")
    got = {(q.folder.rsplit("/", 1)[1], q.page_number, q.variant, q.length) for q in s.inventory(files, "path").collect()}
    assert got == {("a", 1, "", 3), ("a", 2, "_cropped", 30), ("sub", 3, "", 300)}
    plan = files.where("length > 10").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,10)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_salvage():
    cases = {
        '{"a": 1}': '{"a": 1}',
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Here: {"a": 1} hope it helps': '{"a": 1}',
        '{"c": [{"n": "T"}, {"n": "G", "al': '{"c": [{"n": "T"}]}',
        '{"c": [{"n": "A"}, {"n": "B"} {"n": "C"}]}': '{"c": [{"n": "A"}, {"n": "B"}]}',
        '{"c": [{"n": "s}y"}, {"n": "Gr': '{"c": [{"n": "s}y"}]}',
        "no json": None,
        "": None,
        '{"a": ': None,
    }
    for raw, want in cases.items():
        assert r.salvage(raw) == want
    assert r.salvage(None) is None


def test_page_files(spark):
    paths = ["scans/B/page_1.jpg", "scans/B/PAGE_12.JPG", "scans/B/page_3_cropped.jpg", "scans/B/page_x.jpg", "scans/B/cover.jpg", "scans/uploads/page_1.jpg"]
    got = {q.path: (q.page_number, q.variant, q.is_page) for q in s.inventory(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()}
    assert got == {
        paths[0]: (1, "", True),
        paths[1]: (12, "", True),
        paths[2]: (3, "_cropped", False),
        paths[3]: (None, None, False),
        paths[4]: (None, None, False),
    }


def test_reviewed_records(spark, tmp_path):
    good, bad, report = tmp_path / "a.txt", tmp_path / "b.txt", tmp_path / "c.json"
    good.write_text("# note\nbooks/x\n\n s3: scans/y \n")
    bad.write_text("books/x\nnonsense\n")
    report.write_text('{"categories": {"orphans": [{"kind": "s3_prefix", "path": "scans/z"}]}}')
    assert {(q.kind, q.doc_id, q.path) for q in s.reviewed_records(spark, str(good)).collect()} == {("document", "x", None), ("s3_prefix", None, "scans/y")}
    assert s.reviewed_records(spark, str(report)).first().path == "scans/z"
    with pytest.raises(ValueError, match="nonsense"):
        s.reviewed_records(spark, str(bad))


def test_natural_order(spark):
    names = ["img10", "img2", "img1", "IMG3", "img02b", "a", "img"]
    df = o.numbered(spark.createDataFrame([(n,) for n in names], "n string"), [o.natural_key("n"), F.col("n")])
    assert [q.n for q in df.orderBy("place").collect()] == ["IMG3", "a", "img", "img1", "img2", "img02b", "img10"]


def test_reorder_is_a_bijection_and_refuses_holes(spark):
    pages = [("a", i) for i in range(1, 7)] + [("b", i) for i in (1, 2, 4)]
    moves = spark.createDataFrame([("a", 6, 2, 5), ("b", 4, 1, 2)], "book string, n int, source int, target int")
    got = m.reordered(spark.createDataFrame(pages, "book string, page int"), "book", "page", moves).collect()
    assert {q.page: q.new_page for q in got if q.book == "a"} == {1: 1, 2: 5, 3: 2, 4: 3, 5: 4, 6: 6}
    assert all(q.refused and q.page == q.new_page for q in got if q.book == "b")


def test_reorder_sorts_the_pages_once(spark):
    """No book is grouped beside its pages: the plan reads them once, and a repeated, null or surplus page refuses the book."""
    most = m.MOST_PAGES
    pages = [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", None), ("c", 2), ("c", 1), ("d", 1)]
    pages += [(k, i) for k, n in (("full", most), ("over", most + 1)) for i in range(1, n + 1)]
    moves = [("a", 3, 1, 2), ("b", 2, 1, 2), ("c", 2, 2, 1), ("d", 1, 1, 2), ("full", most, 1, most), ("over", most + 1, 1, 2)]
    moves = spark.createDataFrame(moves, "book string, n int, source int, target int")
    out = m.reordered(spark.createDataFrame(pages, "book string, page int"), "book", "page", moves)
    got = out.collect()
    assert len(got) == len(pages) and {q.book for q in got if not q.refused} == {"c", "full"}
    assert all(q.page == q.new_page for q in got if q.refused)
    assert {q.page: q.new_page for q in got if q.book == "c"} == {1: 2, 2: 1}
    assert {q.page: q.new_page for q in got if q.book == "full"} == {1: most} | {i: i - 1 for i in range(2, most + 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_delete_plan_shuffles_no_child_table_for_few_books(spark):
    rows = lambda data, cols: spark.createDataFrame(data, cols)
    books = rows([("a",), ("a",)], "book string")
    pages = rows([("a1", "a"), ("b1", "b"), ("n", None)], "id string, book string")
    people = rows([("ca", "a"), ("cb", "b")], "id string, book string")
    aliases = rows([("by book", "a", "cb"), ("by character", "b", "ca"), ("both", "a", "ca"), ("kept", "b", "cb")], "id string, book string, character string")
    files = rows([("fa", "a"), ("fa", "a"), ("fb", "b")], "id string, book string")
    out = m.delete_plan(books, pages, people, aliases, files)
    want = [("books", "a"), ("pages", "a1"), ("characters", "ca"), ("files", "fa")] + [("aliases", x) for x in ("by book", "by character", "both")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # by sizes that are known before the child tables are touched, not by what a shuffle of them has shown
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan


def test_costs_do_not_gather_the_calls_of_a_model(spark):
    calls = spark.createDataFrame([("a", 10, 4, None, None), ("a", 0, 1, 10, 8), ("x", 5, 5, 5, 5), (None, 1, 1, 1, 1)], "model string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    prices = spark.createDataFrame([("a", 2.0, 10.0), ("b", 1.0, 1.0)], "model string, input double, output double")
    out = c.token_cost(calls, prices)
    assert sorted(q.cost_usd for q in out.collect()) == pytest.approx([0.0, 0.0, 32e-6, 60e-6])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for name in ("n31_token_cost", "s5_cost_order", "g4_cost_report"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(model" not in text, name


def test_import_works_books_out_once(spark, monkeypatch):
    """Only the books are worked out from the sheet, and they take the flags from pages that are worked out already."""
    read = {}
    stage = Store.stage

    def spy(self, tables, *rest):
        read.update({name: " ".join(df.inputFiles()) for name, df in tables.items()})
        return stage(self, tables, *rest)

    monkeypatch.setattr(Store, "stage", spy)
    QUERIES["m12_import"](spark, "/root/testdata/sf0.001")
    assert len(read) == 7 and not [name for name, files in read.items() if "/part.parquet" in files]
    assert {name for name, files in read.items() if "/lineitem.parquet" in files} == {"characters", "aliases"}


def test_audit_suite(spark):
    pages = spark.createDataFrame([("the_gruffalo_1", "books/the_gruffalo"), ("ghost_5", "books/deleted"), ("p", None), ("q", "authors/x")], "id string, ref string")
    books = spark.createDataFrame([("the_gruffalo",)], "id string")
    got = {q.id: q.reason for q in j.dangling(pages, "id", "ref", books, "id", "books").collect()}
    assert got == {"ghost_5": "missing target", "p": "no reference", "q": "wrong collection"}
    counts = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    few = {q.k: q.reason for q in g.image_counts(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", counts).collect()}
    assert few == {"a": None, "b": "only 1 page image", "c": "only 0 page images"}


def test_scope_without_selection_is_everything(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    lists = lambda x: spark.createDataFrame([(x,)], "keys array<int>")
    assert j.in_scope(facts, "k", None).count() == 2
    assert j.in_scope(facts, "k", lists([])).count() == 2  # nothing is selected: all books
    assert j.in_scope(facts, "k", lists([9])).count() == 0 == j.in_scope(facts, "k", lists([None])).count()
    assert j.in_scope(facts, "k", lists([2])).count() == 1


def test_renamed_books_list_their_own_characters(spark):
    """Characters that stand under the new id without a book, and those of another book of that new id, are not listed."""
    books = spark.createDataFrame([("b10", "T", "scans/T", ["x"]), ("b40", "U", "scans/U", []), ("b2", "V", "scans/V", ["y"])], "id string, title string, photos_url string, characters array<string>")
    people = spark.createDataFrame([("b1_1", "b1"), ("b10_2", "b10"), ("b10_1", "b10"), ("b40_7", "b40"), ("b2_1", "b2")], "id string, book string")
    plan = spark.createDataFrame([("b10", "b1", None), ("b40", "b1", None)], "old string, new string, refused string")
    got = sorted((r.id, r.title, r.characters) for r in m.rename_books(books, people, books.select("id", "title"), plan).collect())
    assert got == [("b1", "T", ["b1_1", "b1_2"]), ("b1", "U", ["b1_7"]), ("b2", "V", ["y"])]


def test_names_a_letter_off_are_settled_without_blocking(spark, monkeypatch):
    """Numbered names are all near each other: pairs must not grow with their square, nor results change."""
    total = spark.sparkContext.accumulator(0)

    def counting(cutoff=None):
        def of(option: pd.Series, name: pd.Series) -> pd.Series:
            total.add(len(option))
            return pd.Series(ratios(option.tolist(), name.tolist(), cutoff), dtype="float64")

        return F.pandas_udf(of, "double")

    monkeypatch.setattr(j, "_ratio", counting)
    options = [f"Supplier#{k:09d}" for k in range(400)]
    names = [f"Suplier#{k:09d}" for k in range(0, 400, 2)] + ["supplier#000000007", "supplier#00000007", "supplier#0000000071"]
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    got = {q.name: q.match for q in j.fuzzy_match(one(names), "x", one(options), "x").collect()}
    low = {x.lower(): x for x in options}
    for n in names:
        assert got[n] == low[get_close_matches(n.lower(), list(low), n=1, cutoff=0.8)[0]], n
    assert 0 < total.value < 4000


def test_scorers_hold_a_slice_of_a_batch(spark):
    """A batch's texts are turned into Python strings a slice at a time; nulls, long texts and failures keep their rows."""
    texts = [None, "", "x" * (3 * r.SLICE), *["ab" * 1000] * 2000, None]
    batch = r.pa.RecordBatch.from_arrays([r.pa.array([str(k) for k in range(len(texts))]), r.pa.array(texts)], ["key", "text"])
    parts = list(r.slices(iter([batch])))
    assert [x for _, t in parts for x in t.to_pylist()] == texts and [k for ks, _ in parts for k in ks.to_pylist()] == [str(k) for k in range(len(texts))]
    assert all(len(t) == 1 or sum(len(x or "") for x in t.to_pylist()) <= r.SLICE for _, t in parts) and len(parts) > 4
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {q.key: (q.score, q.error is None) for q in r.scored(df, "k", "t", len).collect()}
    assert got == {str(k): (None if x is None else float(len(x)), x is not None) for k, x in enumerate(texts)}
