"""Exact dedup by distributed MSD radix partitioning.

Each document is the byte string of its text without white space (``[\\x20\\x09-\\x0D]``),
prefixed by its length.  A radix node is a set of documents that agree so far.  Every round
splits all open nodes by their next run of bytes; runs grow sixteenfold, so the number of
rounds is the logarithm of the longest text.  A node of one document, or one whose documents
have ended, is finished.  Documents are compared by their bytes alone, never by a digest.

Rounds move only what is still open: the first one moves a length and sixteen bytes a row,
later ones the bytes of documents that still have company.  Nodes are counted with partial
aggregation and joined back, both sides exchanged by the join alone, so that a node with a
third of all rows is split by adaptive execution.

Defined results: null text is empty; empty texts form one class; null or repeated ``doc_id``
are rows like any other (of equal rows exactly one stays, null ids come last among ties);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep

SPACES = " \t\n\x0b\x0c\r"
#: Bytes of the first digit; each further digit is GROWTH times as wide as all before it.
FIRST, GROWTH = 16, 16


def radix_classes(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, node) of every row that shares its ``body`` (binary) with another; node: least key.

    ``key`` must be unique.  Rows alone in their class are left out.
    """
    length = F.octet_length(body)

    def split(members: DataFrame, tag: str) -> DataFrame:
        """Members (key, size, node, digit) of nodes that keep two rows or more, with the new node."""
        members = keep(members, f"radix-{tag}-digits")
        nodes = keep(
            members.groupBy("node", "digit").agg(F.min(key).alias("least"), F.count("*").alias("n")).where("n > 1"),
            f"radix-{tag}-nodes",
        )
        # the hint keeps both sides on plain exchanges, which adaptive execution can split when skewed
        joined = members.join(nodes.hint("merge"), ["node", "digit"]).select(key, "size", F.col("least").alias("node"))
        out = keep(joined, f"radix-{tag}")
        drop(members, nodes)
        return out

    head = F.concat(F.unhex(F.lpad(F.hex(length.cast("long")), 16, "0")), F.substring(body, 1, FIRST))
    open_ = split(rows.select(key, length.alias("size"), F.lit(0).cast("long").alias("node"), head.alias("digit")), "0")
    done = [open_.where(F.col("size") <= FIRST)]
    texts = keep(
        rows.select(key, body).join(open_.where(F.col("size") > FIRST).select(key), key, "left_semi"), "radix-texts"
    )
    at, level = FIRST, 1
    longest = open_.agg(F.max("size")).first()[0] or 0
    while longest > at:
        width = at * (GROWTH - 1)
        members = (
            open_.where(F.col("size") > at)
            .join(texts, key)
            .select(key, "size", "node", F.substring(body, at + 1, width).alias("digit"))
        )
        open_ = split(members, str(level))
        at, level = at + width, level + 1
        done.append(open_.where(F.col("size") <= at))
        longest = open_.agg(F.max("size")).first()[0] or 0
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(key, "node")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars_original.

    Of equal texts the row stays that has the most code points in its original text, then the
    smallest id.
    """
    body = F.encode(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, ""), "UTF-8")
    rows = keep(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars_original"),
            body.alias("_body"),
        ),
        "dedup-rows",
    )
    classes = keep(radix_classes(rows, "_row", "_body"), "dedup-classes")
    facts = rows.select("_row", "doc_id", "n_chars_original")
    best = F.min(F.struct(-F.col("n_chars_original"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    heads = keep(
        classes.join(facts, "_row").groupBy("node").agg(best.alias("best"), F.count("*").alias("group_size")),
        "dedup-heads",
    )
    grouped = classes.join(heads.hint("merge"), "node").select(
        "_row", "group_size", F.col("best.doc_id").alias("_id"), F.col("best._row").alias("_kept_row")
    )
    alone = F.col("_kept_row").isNull()
    return rows.join(grouped, "_row", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_kept_row") == F.col("_row"))).alias("kept"),
        F.sha2("_body", 256).alias("text_sha256"),
        "n_chars_original",
    )
