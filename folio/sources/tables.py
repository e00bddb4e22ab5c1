"""Sources and sinks: scans, listings, text sources, exports and append-only logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.columns import NON_BOOK_FOLDERS, human_code, normal_title
from folio.sources.snapshots import MOST_FOLDERS, Store

SECRETS = ("password", "token", "secret")


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A projection that tolerates missing fields: absent ones are null, and no row is dropped."""
    if columns is None:
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def book_list(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV: header names are trimmed, rows without a title dropped, all columns strings."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = raw.select(*[F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_")) for c in raw.columns])
    return df.where(F.trim(F.coalesce("title", F.lit(""))) != "")


def character_source(characters: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(characters, aliases, anomalies) keyed by normal title; anomalies have an unrecognised human code."""
    rows = characters.withColumn("norm", normal_title("book")).withColumn("h", human_code("human"))
    known = rows.withColumn("human", F.col("h.human")).drop("h")
    odd = rows.where(~F.col("h.recognised")).select("norm", "name", "human")
    return known, aliases.withColumn("norm", normal_title("book")), odd


def column_json(df: DataFrame, raw: str) -> DataFrame:
    """(k, title, text) of {"Title": {k: ...}, "Text": {k: ...}} documents."""
    doc = F.from_json(raw, "Title map<string,string>, Text map<string,string>")
    rows = df.select(doc.alias("d"))
    titles = rows.select(F.explode("d.Title").alias("k", "title"))
    texts = rows.select(F.explode("d.Text").alias("k", "text"))
    return titles.join(texts, "k", "full")


def first_usable(*sources: DataFrame) -> DataFrame:
    """The first source that has rows (the last otherwise): a whole-source fallback."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def database_table(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a database over JDBC, in ``parts`` ranges of a whole-number key, each read by a task of its own.

    Columns and filters that a query uses go to the database; the bounds are read there first.  An empty table is one range."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    own = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = reader.option("query", f"SELECT MIN({own}) AS LOW, MAX({own}) AS HIGH FROM {table}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if ends[0] is not None and parts > 1:
        reader = reader.options(partitionColumn=key, lowerBound=int(ends[0]), upperBound=int(ends[1]) + 1, numPartitions=parts)
    rows = reader.load()
    return scan(rows, columns) if columns else rows


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the objects under a folder of any store, listed by tasks; no content is read.

    Filters on length and time are applied to the listing before rows are made."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def file_parts(path) -> dict[str, Column]:
    """folder, file, page_number and variant of object paths; null page for anything but a page file."""
    file = F.regexp_extract(path, "[^/]*$", 0)
    pattern = r"(?i)^page_([0-9]+)(_cropped|_display)?\.jpg$"
    number = F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast("int")
    return {
        "folder": F.regexp_extract(path, "^(.*)/[^/]*$", 1),
        "file": file,
        "page_number": number,
        "variant": F.when(number.isNotNull(), F.lower(F.regexp_extract(file, pattern, 2))),
        "is_page": F.coalesce(number.isNotNull() & (F.regexp_extract(file, pattern, 2) == ""), F.lit(False)),
    }


def inventory(listing: DataFrame, path: str) -> DataFrame:
    """The listing with parsed columns, without folders that hold no book."""
    out = listing.withColumns(file_parts(F.col(path)))
    return out.where(~F.regexp_extract("folder", "[^/]*$", 0).isin(*NON_BOOK_FOLDERS))


def reviewed_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of reviewed candidates, one a line: coll/id, s3:path, # comment."""
    text = F.trim(line)
    rows = lines.select(text.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    s3, doc = F.startswith("line", F.lit("s3:")), F.contains("line", F.lit("/"))
    records = rows.where(s3 | doc).select(
        F.when(s3, "s3_prefix").otherwise("document").alias("kind"),
        F.when(~s3, F.substring_index("line", "/", 1)).alias("collection"),
        F.when(~s3, F.regexp_extract("line", "^[^/]*/(.*)$", 1)).alias("doc_id"),
        F.when(s3, F.trim(F.substring(F.col("line"), F.lit(4), F.char_length("line")))).alias("path"),
    )
    return records, rows.where(~s3 & ~doc)


def reviewed_records(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed candidates from a report (object of categories), a JSON list, or a text of lines; a bad line is an error."""
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").first()
    head = first.value.lstrip()[0] if first else ""
    record = "kind string, collection string, doc_id string, path string"
    # the reader takes a document from its file piece by piece; elements of a list are rows at once
    if head == "[":
        return spark.read.schema(record).option("multiLine", True).json(path)
    if head == "{":
        report = spark.read.schema(f"categories map<string,array<struct<{record.replace(' string', ':string')}>>>").option("multiLine", True).json(path)
        return report.select(F.explode("categories").alias("category", "rs")).select(F.explode("rs").alias("r")).select("r.*")
    records, rejects = reviewed_lines(lines)
    if bad := rejects.first():
        raise ValueError(f"unrecognised line: {bad.line!r}")
    return records


def flat(df: DataFrame) -> DataFrame:
    """Every column as a string, nulls as '': what an export writes, with the full schema as header."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        flat(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def people_export(*parts: DataFrame, confirmed: str = "is_confirmed") -> DataFrame:
    """Confirmed people of several tables: all their columns in order of name, secrets left out, nulls as ''."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = sorted(c for c in both.columns if c not in SECRETS)
    return flat(both.where(F.coalesce(confirmed, F.lit(False))).select(*columns))


def feedback_export(feedback: DataFrame, users: DataFrame, user: str, email: str, time: str) -> DataFrame:
    """Feedback with the e-mail of its user ('' if gone) and an ISO time."""
    out = feedback.join(users.select(user, email), user, "left")
    return flat(out.withColumn(time, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")))


def candidate_report(candidates: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(flat table, counts by category with zeros) of audit candidates."""
    spark = candidates.sparkSession
    spine = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = candidates.groupBy("category").agg(F.count("*").alias("n"))
    return flat(candidates), spine.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def append_once(rows: DataFrame, store: Store, table: str, time: str, values: list[str], writer: str, number: int) -> bool:
    """Append records to a store's table with their day; a job run again under the same writer and number adds nothing.

    Values of any type are written as JSON.  Many small appends are brought together now and then."""
    out = rows.withColumns({v: F.to_json(F.struct(F.col(v).alias("v")), {"ignoreNullFields": "false"}) for v in values})
    added = store.write({table: out.withColumn("day", F.date_format(time, "yyyy-MM-dd"))}, writer, number, append=True)
    if len(store.pointer()["tables"][table]["folders"]) > MOST_FOLDERS:
        store.compact(table, f"compact {table}")
    return added


def append_log(rows: DataFrame, path: str, time: str, values: list[str]) -> DataFrame:
    """Append records partitioned by day; values of any type are written as JSON, so no write fails on a type."""
    out = rows.withColumns({v: F.to_json(F.struct(F.col(v).alias("v")), {"ignoreNullFields": "false"}) for v in values})
    out = out.withColumn("day", F.date_format(time, "yyyy-MM-dd"))
    out.write.mode("append").partitionBy("day").parquet(path)
    return out
