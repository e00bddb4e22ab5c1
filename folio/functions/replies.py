"""Model replies as data: normalising, salvaging, and scoring jobs with caller-supplied functions.

No network code lives here; a scorer is any function of pandas columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MOST_CUTS = 50
SNIPPET = 500
#: Bytes of text that a scorer's task holds as Python strings at once.
SLICE = 1 << 20


def page_replies(df: DataFrame, reply: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): text, is_story and page_type of usable JSON replies; the others with their first letters."""
    raw = F.col(reply)
    parsed = F.try_parse_json(raw)
    usable = F.schema_of_variant(parsed).startswith("OBJECT")
    rows = df.withColumns({"_p": parsed, "_ok": F.coalesce(usable, F.lit(False))})
    text = F.get_json_object(raw, "$.text")
    is_text = F.schema_of_variant(F.variant_get("_p", "$.text", "variant")) == "STRING"
    has = F.coalesce(~F.lower(F.get_json_object(raw, "$.has_text")).isin("false", "0", ""), F.lit(True))
    story = F.coalesce(F.lower(F.get_json_object(raw, "$.is_story_page")).isin("true", "1"), F.lit(False))
    pages = rows.where("_ok").withColumns(
        {
            "text": F.when(has & F.coalesce(is_text, F.lit(False)), F.trim(text)).otherwise(""),
            "is_story": story,
            "page_type": F.coalesce(F.get_json_object(raw, "$.page_type"), F.lit("")),
        }
    )
    bare = F.trim(F.coalesce(raw, F.lit("")))
    message = F.when(bare == "", "no usable reply").otherwise(F.concat(F.lit("not usable JSON: "), F.substring(bare, 1, SNIPPET)))
    errors = rows.where("not _ok").withColumn("error_message", message)
    return pages.drop("_p", "_ok", reply), errors.drop("_p", "_ok", reply)


def _closers(text: str) -> str | None:
    """What closes the open brackets of a prefix; null inside a string or when brackets do not match."""
    pairs, stack, quoted, skip = {"}": "{", "]": "["}, [], False, False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in pairs and (not stack or stack.pop() != pairs[ch]):
            return None
    return None if quoted else "".join("}" if ch == "{" else "]" for ch in reversed(stack))


def salvage(raw: str | None) -> str | None:
    """The JSON object in a reply, repaired at its last complete brace if need be; null if none can be had."""
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.split("```")[1].removeprefix("json")
    begin = text.find("{")
    if begin < 0:
        return None
    text = text[begin:]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0], ensure_ascii=False)
    except ValueError:
        pass
    cuts = [i + 1 for i, ch in enumerate(text) if ch == "}"][-MOST_CUTS:]
    for cut in reversed(cuts):
        tail = _closers(text[:cut])
        if tail is not None:
            try:
                return json.dumps(json.loads(text[:cut] + tail), ensure_ascii=False)
            except ValueError:
                continue
    return None


def salvaged(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, parsed, outcome): ok as it is, salvaged, or quarantined.  Only replies the JVM cannot parse reach Python."""
    rows = df.select(F.col(key).alias("key"), F.col(reply).alias("raw"))
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_ok", good)
    fine = rows.where("_ok").select(F.col("key").cast("string").alias("key"), F.col("raw").alias("parsed"), F.lit("ok").alias("outcome"))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = b["raw"].map(lambda r: salvage(r) if isinstance(r, str) else None)
            outcome = parsed.map(lambda p: "quarantined" if p is None else "salvaged")
            yield pd.DataFrame({"key": b["key"], "parsed": parsed, "outcome": outcome})

    rest = rows.where("not _ok").select(F.col("key").cast("string").alias("key"), "raw")
    return fine.unionByName(rest.mapInPandas(repair, "key string, parsed string, outcome string"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of batches (key, text), SLICE bytes of text at a time and one row at least: only so much of a batch is Python strings."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
            yield b.column(0).slice(at, end - at), b.column(1).slice(at, end - at)
            at = end


def scored(df: DataFrame, key: str, text: str, scorer: Callable[[str], object], kind: str = "double", name: str = "score") -> DataFrame:
    """(key, score, error): a scorer on every text; a row that fails becomes an error row, never a failed job.

    ``kind`` and ``name``: type and name of what the scorer gives."""

    own = {"double": float, "string": lambda x: x if x is None or isinstance(x, str) else str(x)}
    cast, made = own.get(kind, lambda x: x), to_arrow_type(T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            scores, errors = [], []
            for t in texts.to_pylist():
                try:
                    scores.append(cast(scorer(t)))
                    errors.append(None)
                except Exception as e:  # whatever a caller's scorer raises is that row's result
                    scores.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:SNIPPET])
            columns = [keys, pa.array(scores, made, from_pandas=True), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", name, "error"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key string, {name} {kind}, error string")


def two_tier(df: DataFrame, key: str, text: str, cheap, costly, accept) -> DataFrame:
    """(key, score, error, tier): the cheap scorer first, the costly one where it failed or ``accept`` (a function of the
    score column) refuses."""
    first = scored(df, key, text, cheap).withColumn("tier", F.lit(1))
    good = F.col("error").isNull() & F.coalesce(accept(F.col("score")), F.lit(False))
    again = df.withColumn("_k", F.col(key).cast("string")).join(first.where(~good).select(F.col("key").alias("_k")), "_k", "left_semi")
    return first.where(good).unionByName(scored(again, key, text, costly).withColumn("tier", F.lit(2)))


def cleaned_in_two_tiers(df: DataFrame, key: str, text: str, cheap, costly) -> DataFrame:
    """(key, cleaned, error, tier, kept): the cheap cleaner first; where it failed, or its text adds a word to the original or
    is blank, the costly one.  ``kept`` tells whether the text that was taken passes that guard.

    The cheap cleaner's texts are written before they are read by either tier, so none is made twice."""
    from folio.operators.aggs import only_removed
    from folio.sources.shared import shared_path

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("original"))

    def tier(part: DataFrame, cleaner, number: int) -> DataFrame:
        path = shared_path(df.sparkSession, f"tier-{number}")
        made = scored(part, "key", "original", cleaner, "string", "cleaned")
        guarded = only_removed(part.join(made, "key"), "original", "cleaned").withColumn("tier", F.lit(number))
        guarded.write.parquet(path)
        return df.sparkSession.read.schema(guarded.schema).parquet(path)

    first = tier(rows, cheap, 1)
    good = F.col("error").isNull() & F.col("kept")
    second = tier(first.where(~good).select("key", "original"), costly, 2)
    return first.where(good).unionByName(second).drop("original")
