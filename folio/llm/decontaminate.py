"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; positions with 0 are ignored, so a changed word
there does not spoil the hash.  Several masks look at every window of the test items and of the
training documents.  Test hashes go into a fixed-size bitmap; a document in whose windows it
strikes keeps those hashes, and Spark joins them with the table of test hashes.  Each hit names
an item and a diagonal (document position less item position).  The documents' own words are
then compared with the item's along the diagonals: a pair is found if any stretch of any of its
diagonals has ``enough`` equal words, or ``share`` of the item's if those are fewer, and at least
``identity`` of it is equal.  Of such stretches the best-scoring one is reported (1 - identity for
an equal word, -identity for another).

Words are runs of letters and digits in lower case, so punctuation and case do not matter.
Equal items count once, under their smallest id.  Items of fewer words than a mask are matched
through the run of all their words; the words of items of fewer than ``least`` stand by chance in many texts, so such an
item is found where the whole document has the item's words and no other.

Defined results: null and empty texts match nothing; repeated rows are each reported; an empty
table on either side gives an empty result; extra columns are ignored.  Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bitmap as bits
from .scratch import fresh, keep
from .words import ALNUM, Words, mix, slices

#: Fixed masks: seven or eight of eleven positions count.
MASKS = ("11101010111", "11010011101", "10111100101", "11001101011", "11111111000")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def _seeds(h: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray]]:
    """(mask, hash of the window from each word) by mask; the last windows are cut off."""
    factor, shifted = 1, []
    for _ in range(max(map(len, masks), default=0)):
        factor = factor * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (2**64 - 1) | 1
        shifted.append(h * np.uint64(factor))
    for mask in masks:
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        out = np.full(n, int(mask, 2) * 2654435761 + len(mask), np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                out += shifted[k][k : k + n]
        yield mask, mix(out)


def _windows(batch: pa.RecordBatch, column: int, masks: tuple[str, ...], least: int):
    """By mask: (mask, row of each word, position of each word, words where a window fits, hashes).

    A mask of fewer than ``least`` words fits whole texts only."""
    words = Words(batch.column(column), ALNUM)
    h, counts = words.hashes(), words.counts
    row = np.repeat(np.arange(words.n), counts)
    at = np.arange(len(h)) - words.first[row] if len(h) else np.zeros(0, np.int64)
    left = counts[row] - at if len(h) else at
    for mask, hashes in _seeds(h, masks):
        room = left[: len(hashes)]
        fits = np.flatnonzero(room >= len(mask) if len(mask) >= least else (room == len(mask)) & (at[: len(hashes)] == 0))
        yield mask, row, at, fits, hashes


def spaced_seed_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    masks: tuple[str, ...] = MASKS,
    least: int = 5,
    enough: int = 13,
    share: float = 0.7,
    identity: float = 0.7,
) -> DataFrame:
    """One row for each pair of a document row and a test item that it holds: doc_id, item_id,
    first_word and last_word of the best stretch in the document, matched, item_words, text_hash
    (xxhash64 of the document's text, to name the row where ids repeat)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("item_text"))
    items = items.agg(F.min(item_id).alias("item_id"))
    items = keep(items.withColumn("_item", F.monotonically_increasing_id()), "decon-items")
    span = max(map(len, masks))

    def lengths(batches):
        for batch in batches:
            n = Words(batch.column(0), ALNUM).counts
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < span)]), pa.int32())], ["n"])

    short = [r.n for r in items.select("item_text").mapInArrow(lengths, "n int").distinct().collect()]
    masks = (*masks, *("1" * n for n in sorted(short)))  # at most span - 1 more

    def test_hashes(batches):
        for batch in batches:
            for part in slices(batch, "item_text"):
                n = Words(part.column(0), ALNUM).counts
                key = part.column(1).to_numpy(zero_copy_only=False)
                for mask, row, at, fits, hashes in _windows(part, 0, masks, least):
                    # a short item is looked for as a whole, a longer one by the spaced masks
                    size = n[row[fits]]
                    good = size == len(mask) if "0" not in mask and len(mask) < span else size >= span
                    fits = fits[good]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[fits].view(np.int64)), pa.array(key[row[fits]], pa.int64()), pa.array(at[fits], pa.int32())],
                        ["hash", "_item", "item_at"],
                    )

    test = keep(
        items.select("item_text", "_item").mapInArrow(test_hashes, "hash long, _item long, item_at int"), "decon-test"
    )
    # a document has thousands of windows, and hardly one may strike by chance
    seen = spark.sparkContext.broadcast(bits.build(test, "hash", each=4096))

    def strikes(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row_of, hash_of, at_of = [], [], []
                for _, row, at, fits, hashes in _windows(part, 1, masks, least):
                    fits = fits[bits.has(seen.value, hashes[fits])]
                    row_of.append(row[fits])
                    hash_of.append(hashes[fits])
                    at_of.append(at[fits])
                rows = np.concatenate(row_of) if row_of else np.zeros(0, np.int64)
                if not len(rows):
                    continue
                order = np.argsort(rows, kind="stable")
                hit, begin = np.unique(rows[order], return_index=True)
                ends = pa.array(np.append(begin, len(rows)), pa.int32())
                kept = part.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [
                        kept.column(0),
                        kept.column(1),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hash_of)[order].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at_of)[order], pa.int32())),
                    ],
                    ["doc_id", "text", "hashes", "at"],
                )

    doc_kind, item_kind = docs.schema[doc_id].dataType, items.schema["item_id"].dataType
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = T.StructType.fromDDL("text string, hashes array<long>, at array<int>")
    struck = docs.mapInArrow(strikes, T.StructType([T.StructField("doc_id", doc_kind), *found.fields]))
    struck = keep(struck.withColumn("_row", F.monotonically_increasing_id()), "decon-struck")
    hits = struck.select("_row", F.explode(F.arrays_zip("hashes", "at")).alias("s"))
    hits = hits.select("_row", F.col("s.hashes").alias("hash"), F.col("s.at").alias("at")).join(test, "hash")
    lines = hits.select("_row", "_item", (F.col("at") - F.col("item_at")).alias("line")).distinct()
    pairs = lines.groupBy("_row", "_item").agg(F.collect_list("line").alias("lines"))
    full = pairs.join(struck.select("_row", "doc_id", "text"), "_row").join(items, "_item")

    def verify(batches):
        for batch in batches:
            out, last, doc = [], None, []
            for r in batch.to_pylist():
                if r["text"] is not last and r["text"] != last:
                    last, doc = r["text"], words_of(r["text"])
                item, best = words_of(r["item_text"]), None
                need = min(enough, int(np.ceil(share * len(item))))
                for line in sorted(r["lines"]):
                    found = best_stretch(doc, item, line, need, identity)
                    if found and (best is None or found[:2] > best[:2]):
                        best = found
                if best:
                    out.append((r["doc_id"], r["item_id"], best[2], best[3], best[1], len(item), r["text_hash"]))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow, strict=True)], names)

    names = ["doc_id", "item_id", "first_word", "last_word", "matched", "item_words", "text_hash"]
    kinds = [doc_kind, item_kind, *[T.LongType()] * 5]
    arrow = [to_arrow_type(k) for k in kinds]
    full = full.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "item_id", "item_text", "lines")
    return full.mapInArrow(verify, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def best_stretch(doc: list[str], item: list[str], line: int, need: int, identity: float) -> tuple[int, int, int, int] | None:
    """(score, equal words, first, last word in doc) of the best-scoring stretch on a diagonal that has
    ``need`` equal words, ``identity`` of it at least; nothing if there is none."""
    lo = max(0, -line)
    hi = max(lo, min(len(item), len(doc) - line))
    equal = np.array([a == b for a, b in zip(doc[lo + line : hi + line], item[lo:hi], strict=True)], bool)
    at = np.flatnonzero(equal)
    need = max(need, 1)
    if len(at) < need:
        return None
    # a best stretch begins and ends with equal words: scores are whole numbers, up to and with a word
    mark = Fraction(str(identity))
    score = mark.denominator * np.arange(1, len(at) + 1) - mark.numerator * (at + 1)
    before = score - mark.denominator + mark.numerator
    # the best beginning for each end among those that leave enough equal words: the lowest score before it
    low = np.minimum.accumulate(before)[: len(at) - need + 1]
    gain = score[need - 1 :] - low
    end = int(np.argmax(gain))
    if gain[end] < 0:
        return None
    begin = int(np.argmin(before[: end + 1]))
    end += need - 1
    return int(gain.max()), end - begin + 1, int(at[begin]) + lo + line, int(at[end]) + lo + line


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    found = keep(spaced_seed_matches(docs, benchmark, doc_id, text, **options), "decon-found")
    id_, hash_ = fresh(docs.columns, "id", "hash")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_))
    return docs.join(found, same, "left_anti")
