"""Ranked lexical search: FP-trees over documents, searched by branch and bound for each item.

The items are the stated query set; every document is ranked for each of them.  A document is restricted to the
terms that items use and becomes a vector of (term, occurrences), terms in falling order of how many documents hold
them.  Documents are taken in blocks of bounded size.  In a block the sorted vectors make a trie whose paths
documents share (an FP-tree over documents); a node knows, for each term, the most occurrences (tf) below it, and the
least length factor m below it.  An item's score of these two is a bound for every document below the node, as a
term's part rises with tf and falls with m.  Each item descends depth first, best child first, and passes over
nodes whose bound is under its ``top``-th score so far; documents of the leaves that are reached are scored exactly.
A task carries its items' best from block to block and hands over at most ``top`` rows an item; the
best of all tasks are merged in two steps.

Score (64-bit integers, div rounds down): sum over the item's terms, repeats included, of
w * ((10**9 * tf) div (1000 * tf + 12 * m)), w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 75 + ((25 n N) div L).

Items go in blocks of ``ITEMS``; what is broadcast is one such block's terms.  Terms are compared by 64-bit hashes:
among a billion different terms one is taken for one of 4000 query terms with a chance near 2e-7.

Defined results: null and empty texts have no terms, are not counted and never found; items without terms
have no rows; equal scores go by ascending id, null ids last; repeated documents are ranked one by one, repeated items are
each answered; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, keep
from .words import ALNUM, Words, slices

TOP = 20
#: Items whose terms are broadcast together, items that share a tree, documents of a leaf.
ITEMS, TREE_ITEMS, LEAF = 4096, 256, 64
#: Documents and entries (documents x terms) of a tree.
TREE_DOCS, TREE_ENTRIES = 4096, 1 << 24
#: Groups of tasks whose best are merged first.
MERGES = 64


class Queries:
    """The items of a block: for each its place in ``numbers``, its terms as places in the sorted ``terms``, and how often."""

    def __init__(self, rows: pa.Table):
        self.numbers = rows["number"].to_numpy()
        words = Words(pa.concat_arrays(rows["text"].cast(pa.large_string()).chunks) if len(rows) else pa.array([], pa.large_string()), ALNUM)
        hashes = words.hashes()
        self.terms = np.unique(hashes)
        at = np.searchsorted(self.terms, hashes)
        self.of = [np.unique(at[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:])]


def term_vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """id, n (all terms with repeats), and the document's query terms (places in ``terms``) with occurrences; n > 0."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches):
        terms = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1), ALNUM)
                h, n = words.hashes(), words.counts
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                row = np.repeat(np.arange(words.n), n)
                hit = terms[at] == h
                key, tf = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
                first = np.searchsorted(key, np.arange(words.n + 1) * len(terms)).astype(np.int32)
                ints = lambda x, first=first: pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32)))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), ints(key % len(terms)), ints(tf)], ["id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    kinds = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", kinds), T.StructField("tf", kinds)])
    return docs.mapInArrow(vectors, schema)


def part_scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of occurrences (rows x terms, whole numbers) at length factors m."""
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None]))).sum(1)


class Tree:
    """The FP-tree of a block: rows sorted by their term vectors, cut into leaves, and nodes over ranges of leaves."""

    def __init__(self, row: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, width: int):
        """Entries (row, rank, tf), rank 0 being the term most documents hold; m by row."""
        order = np.argsort(row * width + rank)
        row, rank, tf = row[order], rank[order], tf[order]
        first = np.searchsorted(row, np.arange(len(m) + 1))
        path = rank.astype(">u4").tobytes()
        paths = [path[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:])]
        self.order = np.array(sorted(range(len(m)), key=paths.__getitem__), np.int64)
        self.m = m[self.order]
        place = np.empty(len(m), np.int64)
        place[self.order] = np.arange(len(m))
        self.tf = np.zeros((len(m), width), np.uint32)
        self.tf[place[row], rank] = tf
        self._rank, self._start, self._length = rank, first[:-1][self.order], np.diff(first)[self.order]
        self.leaves: list[tuple[int, int]] = []
        self.nodes: list[tuple[int, int, list[int]]] = []  # leaves a to b, children
        self.root = self._grow()
        starts = [lo for lo, _ in self.leaves]
        most, least = np.maximum.reduceat(self.tf, starts, axis=0), np.minimum.reduceat(self.m, starts)
        self.most = np.stack([most[a:b].max(0) for a, b, _ in self.nodes])
        self.least = np.array([least[a:b].min() for a, b, _ in self.nodes])

    def _leaf(self, lo: int, hi: int) -> int:
        self.leaves.append((lo, hi))
        self.nodes.append((len(self.leaves) - 1, len(self.leaves), []))
        return len(self.nodes) - 1

    def _shared(self, lo: int, hi: int) -> int:
        """How many terms the paths of rows lo to hi share: those of the first and the last, as rows are sorted."""
        n = min(self._length[lo], self._length[hi - 1])
        a, b = (self._rank[self._start[k] : self._start[k] + n] for k in (lo, hi - 1))
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if len(differ) else int(n)

    def _grow(self) -> int:
        """Nodes from the leaves up; a node's children are runs of rows with one next term, small neighbours in one leaf."""
        open_ = [(0, len(self.m), None)]
        top: list[int] = []
        while open_:
            lo, hi, into = open_.pop()
            into = top if into is None else into
            if lo < 0:  # all children of a node are there
                children = hi
                self.nodes.append((self.nodes[children[0]][0], self.nodes[children[-1]][1], children))
                into.append(len(self.nodes) - 1)
                continue
            depth = self._shared(lo, hi) if hi - lo > LEAF else 0
            if hi - lo <= LEAF or depth == self._length[lo] == self._length[hi - 1]:
                into.append(self._leaf(lo, hi))
                continue
            inside = self._length[lo:hi] > depth
            at = np.minimum(self._start[lo:hi] + depth, len(self._rank) - 1)
            cuts = np.flatnonzero(np.diff(np.where(inside, self._rank[at], -1))) + 1
            runs, children = [], []
            for a, b in zip([0, *cuts], [*cuts, hi - lo]):
                if runs and b - runs[-1][0] <= LEAF:
                    runs[-1][1] = b
                else:
                    runs.append([int(a), int(b)])
            open_.append((-1, children, into))
            open_.extend((lo + a, lo + b, children) for a, b in reversed(runs))
        return top[0]


class Best:
    """An item's best rows so far: scores, and where ids are null, ids."""

    def __init__(self, top: int):
        self.top, self.scores, self.nulls, self.ids = top, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        scores, nulls, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.nulls, nulls), (self.ids, ids)))
        order = np.lexsort((ids, nulls, -scores))[: self.top]
        self.scores, self.nulls, self.ids = scores[order], nulls[order], ids[order]


def descend(tree: Tree, at: np.ndarray, weights: np.ndarray, nulls: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Branch and bound of one item through a tree; ``at`` are its terms' ranks.  Returns how many rows it scored."""
    bounds = part_scores(weights, tree.most[:, at], tree.least)
    stack, scored = [tree.root], 0
    while stack:
        node = stack.pop()
        if bounds[node] < best.least:
            continue
        first, last, children = tree.nodes[node]
        if children:
            stack.extend(sorted(children, key=bounds.__getitem__))
            continue
        lo, hi = tree.leaves[first]
        scores = part_scores(weights, tree.tf[lo:hi, at], tree.m[lo:hi])
        scored += hi - lo
        good = np.flatnonzero(scores >= best.least)
        if len(good):
            rows = tree.order[lo + good]
            best.add(scores[good], nulls[rows], ids[rows])
    return scored


def search(vectors: DataFrame, queries: Queries, documents: int, length: int, held: np.ndarray, top: int) -> DataFrame:
    """number, id, score: each task's best rows of each item.  ``held``: documents that hold each term."""
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    groups = []
    for k in range(0, len(queries.of), TREE_ITEMS):
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[at for at, _ in queries.of[k : k + TREE_ITEMS]]]))
        used = used[np.lexsort((used, -held[used]))]
        rank = np.full(len(held), -1, np.int32)
        rank[used] = np.arange(len(used))
        if len(used):
            groups.append((k, rank, len(used)))
    shared = vectors.sparkSession.sparkContext.broadcast((queries.of, queries.numbers, weights, groups))

    def run(batches):
        of, numbers, weights, groups = shared.value
        best = [Best(top) for _ in of]
        for batch in batches:
            ids = batch.column(0)
            nulls = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = 75 + (25 * documents * batch.column(1).to_numpy()) // length
            entries = batch.column(2)
            offsets = entries.offsets.to_numpy()
            terms, tf = entries.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            for k, rank, width in groups:
                step = max(LEAF, min(TREE_DOCS, TREE_ENTRIES // width))
                for lo in range(0, batch.num_rows, step):
                    hi = min(lo + step, batch.num_rows)
                    a, b = offsets[lo] - offsets[0], offsets[hi] - offsets[0]
                    of_term = rank[terms[a:b]]
                    mine = np.flatnonzero(of_term >= 0)
                    row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))[mine]
                    tree = Tree(row, of_term[mine].astype(np.int64), tf[a:b][mine], m[lo:hi], width)
                    for i in range(k, min(k + TREE_ITEMS, len(of))):
                        at, times = of[i]
                        if len(at):
                            descend(tree, rank[at], weights[at] * times, nulls[lo:hi], ids[lo:hi], best[i])
        for number, found in zip(numbers, best):
            if len(found.scores):
                ids = pa.array(found.ids, mask=found.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), ids, pa.array(found.scores)], ["number", "id", "score"])

    return vectors.mapInArrow(run, "number long, id long, score long")


def best_rows(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each number with their rank, merged by groups of tasks and then over these."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    found = found.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "task").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= top).drop("task")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item with a score above 0.  Ids of documents are whole numbers."""
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # rows of items get numbers, so that repeated ones are told apart and blocks are even
    items = keep(items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text")).withColumn("number", F.monotonically_increasing_id()), "search-items")
    blocks = max(1, -(-items.count() // ITEMS))
    found = None
    for block in range(blocks):
        queries = Queries(items.where(F.pmod(F.hash("number"), F.lit(blocks)) == block).select("number", "text").toArrow())  # about ITEMS rows
        if not len(queries.terms):
            continue
        vectors = keep(term_vectors(docs, queries.terms), "search-vectors")
        total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not total.n:
            drop(vectors)
            continue
        # one row for each term of the block's items
        counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
        held = np.zeros(len(queries.terms), np.int64)
        held[counts["term"].to_numpy()] = counts["n"].to_numpy()
        part = search(vectors, queries, total.n, total.length, held, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "number long, id long, score long")
    out = best_rows(found, top).join(items.select("number", "item_id"), "number")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
n AS (SELECT r, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*) AS docs, sum(n) AS total FROM n),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
w AS (
  SELECT item_id, term, times * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM q JOIN f USING (term), g),
s AS (
  SELECT w.item_id, t.r,
         sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * CAST(75 + (25 * n.n * g.docs) // g.total AS BIGINT)))) AS score
  FROM w JOIN t USING (term) JOIN n USING (r), g GROUP BY w.item_id, t.r),
k AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 20"""
