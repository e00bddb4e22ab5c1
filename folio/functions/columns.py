"""Column expressions: normal forms, codes, identifiers and verdicts.

All are built-in JVM expressions, so they stay inside one generated stage and next to the scan.
A string argument names a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that are real though a rule below would call them junk.
REAL_NAMES = ("li", "wu", "xu", "yu", "lu", "ng", "an", "bo", "ed", "jo", "al", "mo", "j k", "jk", "aa milne", "ee cummings")
#: Test and placeholder names.
JUNK_TOKENS = (
    "test", "testing", "tester", "testbook", "testing123", "bla", "blah", "blabla", "blahblah", "blablabla",
    "asdf", "asdfasdf", "asdfg", "asdfgh", "asdfghjkl", "qwerty", "qwertyuiop", "qwe", "qwer", "wer", "wert",
    "zxc", "zxcv", "zxcvbn", "zxcvbnm", "xxx", "xxxx", "yyy", "zzz", "aaa", "aaaa", "foo", "bar", "baz", "foobar", "qux",
    "lorem", "ipsum", "dummy", "sample", "example", "examples", "abc", "abcd", "abcde", "abcdef",
    "temp", "tmp", "delete", "deleteme", "remove", "removeme", "ignore", "ignoreme", "junk", "rubbish", "nonsense",
    "none", "null", "nil", "na", "nan", "todo", "tbd", "tba", "untitled", "noname", "no name", "placeholder",
    "new book", "newbook", "book", "mybook", "my book", "title", "name",
)
#: Rows of a keyboard; a walk is this many neighbouring keys in either direction.
KEY_ROWS, WALK = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890"), 4
#: Articles and possessives.
ARTICLES = ("the", "an", "a", "my", "your", "his", "her", "its", "our", "their")
#: Spellings of an absent value, of true and of false.
UNKNOWN, TRUE, FALSE = ("", "unknown", "n/a", "none", "null"), ("true", "yes", "1"), ("false", "no", "0")
#: Roles, character genders, folders that hold no book.
ROLES = ("archivist", "team", "admin")
GENDERS = ("Female", "Male", "Non-specific", "Transgender")
NON_BOOK_FOLDERS = ("uploads",)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(c: Column, values) -> Column:
    return c.isin(*values)


def equal_to(df: DataFrame, field: str, value) -> DataFrame:
    """Equality filter; reaches the scan."""
    return df.where(F.col(field) == value)


def among(df: DataFrame, field: str, values) -> DataFrame:
    """IN filter: a literal list, or a DataFrame of keys (its first column) for long ones."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("_key")).distinct()
        return df.join(keys, F.col(field) == F.col("_key"), "left_semi")
    return df.where(F.col(field).isin(*values))


def range_search(df: DataFrame, field: str, start: str) -> DataFrame:
    """start <= field <= start + 'z', byte order: narrower than a prefix match."""
    return df.where(F.col(field).between(start, start + "z"))


def contains_search(df: DataFrame, field: str, term: str | None) -> DataFrame:
    """Case-insensitive contains; a blank term finds nothing."""
    if not (term or "").strip():
        return df.limit(0)
    return df.where(F.contains(F.lower(field), F.lit(term.strip().lower())))


def normal_title(c) -> Column:
    text = F.replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def document_id(*parts) -> Column:
    """Lower-cased parts joined by underscores, spaces become underscores."""
    return F.lower(F.translate(F.concat_ws("_", *[col(p).cast("string") for p in parts]), " ", "_"))


def person_id(forename, surname) -> Column:
    return F.lower(F.translate(F.concat_ws(" ", col(forename), col(surname)), " ", "_"))


def collection_id(owner, name) -> Column:
    slug = lambda c: F.lower(F.translate(F.trim(F.coalesce(col(c), F.lit(""))), " ", "_"))
    return F.when(slug(owner) == "", slug(name)).otherwise(F.concat_ws("_", slug(owner), slug(name)))


def identity(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))), F.lit(""))


def split_name(c) -> Column:
    """struct(forename, surname): the last word is the surname; a single word is a forename."""
    words = F.array_remove(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+"), "")
    n = F.size(words)
    first = F.when(n > 1, F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    last = F.when(n > 1, F.element_at(words, -1)).otherwise("")
    return F.struct(first.alias("forename"), last.alias("surname"))


def display_name(name, forename, surname, ref=None) -> Column:
    """name, else both parts, else the id of a reference in words, else Unknown."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = F.concat_ws(" ", F.coalesce(col(forename), F.lit("")), F.coalesce(col(surname), F.lit("")))
    options = [filled(col(name)), filled(parts)]
    if ref is not None:
        options.append(filled(F.translate(col(ref), "_", " ")))
    return F.coalesce(*options, F.lit("Unknown"))


def coded(c, mapping: dict[str, str], default: str | None) -> Column:
    """Map of upper-cased, trimmed codes; anything else is the default."""
    code = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    out = reduce(lambda w, kv: w.when(code == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), ""))
    return out.otherwise(F.lit(default))


def author_gender(c) -> Column:
    return coded(c, {"M": "Man", "F": "Woman"}, "Unknown")


def character_gender(c) -> Column:
    return coded(c, {"F": "Female", "M": "Male"}, "Non-specific")


def human_code(c) -> Column:
    """struct(human, recognised): strays count as human and are marked."""
    code = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.struct((code != "NH").alias("human"), code.isin("H", "NH").alias("recognised"))


def is_unknown(c) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).isin(*UNKNOWN)


def as_bool(c, default: bool = True) -> Column:
    """Booleans and their spellings (as strings); anything else is the default."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).otherwise(F.lit(default))


def year_of(c, this_year: int) -> Column:
    """The first four digits in a row, if from 1900 to this year."""
    found = F.nullif(F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"[0-9]{4}", 0), F.lit("")).cast("int")
    return F.when(found.between(1900, this_year), found)


def whole_number(c) -> Column:
    """A number in a string, cut to whole."""
    return F.trim(col(c).cast("string")).try_cast("double").try_cast("int")


def page_range(start, end) -> Column:
    """struct(start, end) when 1 <= start <= end, else null."""
    s, e = whole_number(start), whole_number(end)
    return F.when((s >= 1) & (e >= s), F.struct(s.alias("start"), e.alias("end")))


def in_story(page, start, end) -> Column:
    """Whether a page is inside the range; every page is when there is no range."""
    r = page_range(start, end)
    return F.coalesce(col(page).between(r["start"], r["end"]), F.lit(True))


def author_field(author, code) -> Column:
    """struct(author, code, second, review) from a row that may name two authors."""
    name, codes = F.trim(F.coalesce(col(author), F.lit(""))), F.trim(F.coalesce(col(code), F.lit("")))
    people, letters = F.split(name, " and "), F.transform(F.split(codes, "/"), lambda x: F.trim(x))
    pair = (F.size(people) == 2) & (F.size(letters) == 2) & F.forall(letters, lambda x: x.rlike(r"^\p{L}$"))
    first, second = F.trim(F.get(people, F.lit(0))), F.trim(F.get(people, F.lit(1)))

    def row(a, c, s, review):
        return F.struct(a.alias("author"), c.alias("code"), s.alias("second"), F.lit(review).alias("review"))

    empty = F.lit("")
    alone = ~first.rlike(r"\S\s+\S")
    return (
        F.when(F.size(letters) >= 3, row(name, empty, empty, True))
        .when(pair & alone, row(empty, empty, second, True))
        .when(pair, row(first, F.get(letters, F.lit(0)), second, False))
        .otherwise(row(name, codes, empty, False))
    )


def blank_text(c) -> Column:
    """Empty when nothing but marks and tags is left, else the text as it is."""
    text = F.coalesce(col(c), F.lit(""))
    return F.when(F.regexp_replace(text, "<[^>]*>", "").rlike(r"[\p{L}\p{N}]"), text).otherwise("")


def isbn(c) -> Column:
    """An ISBN-13 if one is found, else an ISBN-10; no check digit is verified."""
    text = F.coalesce(col(c), F.lit(""))
    # The layouts of an ISBN of thirteen and of ten digits
    long = F.regexp_extract(text, r"97[89][-\s]?(?:[0-9][-\s]?){9}[0-9]", 0)
    short = F.regexp_extract(text, r"\b[0-9][-\s]?(?:[0-9][-\s]?){8}[0-9X]\b", 0)
    return F.regexp_replace(F.coalesce(F.nullif(long, F.lit("")), F.nullif(short, F.lit(""))), r"[-\s]", "")


def without_article(c) -> Column:
    """One leading article or possessive taken off, unless nothing would be left."""
    bare = F.trim(F.regexp_replace(col(c), rf"(?i)^\s*({'|'.join(ARTICLES)})\s+", ""))
    return F.when(bare == "", F.trim(col(c))).otherwise(bare)


def keyboard_walks() -> str:
    """A pattern of all walks, from the keyboard rows."""
    rows = [r for row in KEY_ROWS for r in (row, row[::-1])]
    return "|".join(sorted({r[i : i + WALK] for r in rows for i in range(len(r) - WALK + 1)}))


def junk_reason(c, real=REAL_NAMES, tokens=JUNK_TOKENS) -> Column:
    """Why a name looks like junk, or null; the first rule that fits counts."""
    name = F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))
    dense, words = F.translate(name, " ", ""), F.split(name, " ")
    known = F.array(*[F.lit(t) for t in tokens])
    return (
        F.when(name.isin(*real), None)
        .when(name == "", "empty")
        .when(F.char_length(dense) <= 2, "short")
        .when(name.isin(*tokens), "placeholder")
        .when(F.size(F.array_except(words, known)) == 0, "all placeholders")
        .when(dense.rlike(r"^(.)\1*$"), "one character")
        .when(dense.rlike("^[0-9]+$"), "numeric")
        .when(dense.rlike(keyboard_walks()), "keyboard walk")
    )


def owner_of(c) -> Column:
    """The name in a reference or plain string; blank is null."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(col(c), F.lit("")), "[^/]*$", 0)), F.lit(""))


def effective_role(role, admin) -> Column:
    return F.when(col(role).isin(*ROLES), col(role)).when(F.coalesce(col(admin), F.lit(False)), "admin").otherwise("archivist")


def folder_of(url, title) -> Column:
    """Last path segment of a url, else the title."""
    source = F.coalesce(F.nullif(F.trim(col(url)), F.lit("")), col(title), F.lit(""))
    return F.element_at(F.split(F.regexp_replace(source, "/+$", ""), "/"), -1)


def is_email(c) -> Column:
    """A local part, one @ and a dotted domain, at most 254 characters."""
    text = F.coalesce(col(c), F.lit(""))
    return text.rlike(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$") & (F.char_length(text) <= 254)


def review_verdict(sense, fits, has_text) -> Column:
    """struct(needs_review, priority) from two verdicts and whether there is text."""
    s, f, t = col(sense), col(fits), col(has_text)
    priority = F.when(s & f, "").when(~f & (~s | ~t), "high").otherwise("normal")
    return F.struct((~(s & f)).alias("needs_review"), priority.alias("priority"))


def skip_ocr(flows, missing) -> Column:
    return F.coalesce(col(flows), F.lit(False)) & ~F.coalesce(col(missing), F.lit(False))


def reopen_block(validated, active) -> Column:
    """Why a submitted book may not be reopened, or null."""
    return F.when(F.coalesce(col(validated), F.lit(False)), "validated").when(F.coalesce(col(active), F.lit(False)), "validation_active")


def themes(old: dict[str, str], new: dict[str, str]) -> tuple[dict[str, Column], Column]:
    """Flags that are only ever turned on, and the array of those newly on."""
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    merged = {k: yes(old[k]) | yes(new[k]) for k in old}
    added = F.array_compact(F.array(*[F.when(~yes(old[k]) & yes(new[k]), F.lit(k)) for k in old]))
    return merged, added


def flow_key(c) -> Column:
    return F.translate(F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("unlabelled")), ".", "_")


def positions(c, n) -> Column:
    """The whole numbers from 1 to n in an array of strings: distinct, sorted; a null array is empty."""
    found = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.trim(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.between(1, col(n)))))


def name_list(c) -> Column:
    """Names in a JSON value that is a string or a list of them: trimmed, blanks dropped."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    many = F.from_json(text, "array<string>")
    one = F.array(F.regexp_replace(text, '^"|"$', ""))
    names = F.when(text.startswith("["), many).when(text.isin("", "null"), F.array().cast("array<string>")).otherwise(one)
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")


def in_vocabulary(c, words, default) -> Column:
    return F.when(col(c).isin(*words), col(c)).otherwise(F.lit(default))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Every declared field present; null and NaN become its default (a null default stays null)."""
    kinds = dict(df.dtypes)
    out = {}
    for name, value in defaults.items():
        if name not in kinds:
            out[name] = F.lit(value)
        elif value is not None:
            gone = F.col(name).isNull() | (F.isnan(name) if kinds[name] in ("double", "float") else F.lit(False))
            out[name] = F.when(gone, F.lit(value)).otherwise(F.col(name))
    return df.withColumns(out)


def stamped(df: DataFrame, user: str, now, is_new="is_new") -> DataFrame:
    """Audit stamp: owner and creation time are set once, the change time always."""
    new = col(is_new)
    return df.withColumns(
        {
            "entered_by": F.coalesce("entered_by", F.when(new, F.lit(user))),
            "datetime_created": F.coalesce("datetime_created", F.when(new, F.lit(now))),
            "is_registered": F.lit(True),
            "last_updated": F.lit(now),
        }
    )


def token_cost(df: DataFrame, prices: DataFrame, read_rate: float = 0.1, write_rate: float = 1.25) -> DataFrame:
    """cost_usd from token counts; prices (model, input, output in $ per million): one row a model.

    Cache reads and writes are billed at a share of the input price; an unknown model costs 0.  The prices are broadcast: calls
    are of a few models, so by model a few tasks would read them all.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    units = n("input_tokens") + n("cache_read") * read_rate + n("cache_write") * write_rate
    cost = (units * F.col("input") + n("output_tokens") * F.col("output")) / 1e6
    return df.join(F.broadcast(prices), "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("input", "output")
