"""URL filter: rules first, then gradient-boosted trees on lexical features of the URL.

Features are column expressions: lengths, depth, digit ratios, hyphens, host labels, vowels, character entropy of the host, parameter
counts, and suffix statistics, that is how many labelled URLs share the last label of the host, its last two
labels or the ending of the path, and which share of them is to be blocked.  The statistics come from all labelled
URLs, each counted once, as sums in ``SLOTS`` slots a kind that suffixes are hashed to, so they are of bounded
size and can be broadcast; they are kept by fold, and a URL uses the folds other than its own, in training and in
scoring alike, so that it never meets its own label.  The trees are fitted by ``GBTClassifier`` on ``SAMPLE`` labelled
URLs at most, half of them of each label and weighed back to their numbers.  Hosts with crc32(host) mod 5 = 0 are kept
from statistics and trees, to measure the filter on hosts it never saw.

Labelled URLs are a table (url, label 1: block) of the caller's.  Without one, URLs label themselves by ``words``: 1 where
a word of the host, cut at dots and hyphens, is one of them.  No feature looks at words, so the trees also judge hosts that the
list lacks, by their form.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's; the longest
host, then the longest path wins, then 'allow' over 'block'.  Rules are joined by host, one join for each number of labels
that rule hosts have; Spark broadcasts them only while they are small.

Defined results: a null URL or one without '://' has empty host and path and is judged by its features like
others; null labels are ignored, labels of one URL agree by their mean (ties: 1); with labels of one kind or none every verdict
is that kind's, or 'allow' without any; repeated rows are judged each; an empty table gives an empty result; other columns stay,
but those named host, path, rule, verdict, score or held_out in any case are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, fresh, keep

#: Labelled URLs that the trees are fitted on, and slots of each kind of suffix.
SAMPLE, SLOTS = 20_000, 1 << 16
FOLDS, TREES, DEPTH = 5, 20, 4
#: Words of hosts that are to be blocked, where no labelled URLs are given.
WORDS = "ad ads adult bet bets betting casino casinos gambling pharma pills poker porn sex slots spam viagra warez xxx".split()
OUT = ("host", "path", "rule", "verdict", "score", "held_out")


def url_parts(url: Column) -> dict[str, Column]:
    """host, path and query of a URL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", k), F.lit(""))
    return {"host": F.translate(part(1), upper, lower), "path": part(2), "query": part(3)}


def _without(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def lexical(url: Column, host: Column, path: Column, query: Column) -> dict[str, Column]:
    """The features of a URL's characters, by name, as doubles."""
    size = lambda c: F.length(c).cast("double")
    ratio = lambda c, pattern: _without(c, pattern) / F.greatest(F.length(c), F.lit(1))
    n = size(host)
    share = lambda x: (n - F.length(F.replace(host, x, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), lambda a, x: a - F.when(share(x) > 0, share(x) * F.log2(share(x))).otherwise(0.0))
    return {
        "length": F.coalesce(size(url), F.lit(0.0)),
        "host_length": n,
        "path_length": size(path),
        "depth": _without(path, "/"),
        "host_labels": _without(host, "[.]"),
        "hyphens": _without(host, "-"),
        "host_digits": ratio(host, "[0-9]"),
        "path_digits": ratio(path, "[0-9]"),
        "vowels": ratio(host, "[aeiou]"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "query_length": size(query),
        "parameters": F.when(F.length(query) > 1, 1 + _without(query, "[&;]")).otherwise(0),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The suffixes that statistics are kept of; '' where there is none."""
    return {
        "last_label": F.substring_index(host, ".", -1),
        "last_labels": F.substring_index(host, ".", -2),
        "ending": F.regexp_extract(path, r"([.][A-Za-z0-9]{1,8}|/)$", 1),
    }


def _slot(kind: str, suffix: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), suffix), F.lit(SLOTS)).cast("int")


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def held_out(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % 5 == 0


def by_words(urls: DataFrame, url: str, words: list[str] = WORDS) -> DataFrame:
    """(url, label) by the words of hosts."""
    listed = F.arrays_overlap(F.split(url_parts(F.col(url))["host"], "[.-]"), F.array(*[F.lit(w) for w in words]))
    return urls.select(F.col(url).alias("url"), F.coalesce(listed, F.lit(False)).cast("int").alias("label"))


class UrlModel:
    """Suffix statistics and trees, of bounded size."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE):
        self.names = [*lexical(*[F.lit("")] * 4), *[f"{k}_{x}" for k in suffixes(F.lit(""), F.lit("")) for x in ("n", "rate")]]
        once = labelled.where("url is not null and label is not null").groupBy("url").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        parts = url_parts(F.col("url"))
        once = once.select("url", "label", *[c.alias(k) for k, c in parts.items()])
        once = keep(once.where(~held_out(F.col("host"))).withColumn("fold", _fold(F.col("url"))), "url-labelled")
        total = once.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
        self.prior = total.ones / total.n if total.n else 0.0
        kinds = suffixes(F.col("host"), F.col("path"))
        slots = F.array(*[F.struct(F.lit(k).alias("kind"), _slot(k, c).alias("slot")) for k, c in kinds.items()])
        ones = lambda k: F.sum(F.when(F.col("fold") == k, F.col("label")).otherwise(0))
        alls = lambda k: F.count(F.when(F.col("fold") == k, 1))
        sums = once.select("fold", "label", F.inline(slots)).groupBy("kind", "slot").agg(
            F.array(*[alls(k) for k in range(FOLDS)]).alias("alls"), F.array(*[ones(k) for k in range(FOLDS)]).alias("ones")
        )
        self.statistics = keep(sums, "url-suffixes", tasks=1)
        self.trees = None
        if 0 < total.ones < total.n:
            self.trees = self._fit(once, {1: total.ones, 0: total.n - total.ones}, sample)
        drop(once)

    def _fit(self, once: DataFrame, counts: dict[int, int], sample: int):
        chosen = None
        for label, n in counts.items():
            most = max(1, sample // 2)
            # about twice as many as are wanted by a range of hashes, of these the first: no task sorts the whole
            limit = int(min(1.0, 2 * most / n + 100 / n) * 2**31)
            near = once.where((F.col("label") == label) & (F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(2**31)) < limit))
            part = near.orderBy(F.xxhash64("url", F.lit("sample")), "url").limit(most).withColumn("weight", F.lit(max(n / most, 1.0)))
            chosen = part if chosen is None else chosen.unionByName(part)
        rows = self.features(chosen, "url", "host", "path", "query", self.names).select(*self.names, F.col("label").cast("double").alias("label"), "weight")
        # at most ``sample`` rows of fixed width, in one order
        rows = keep(rows.repartition(1).sortWithinPartitions(*self.names, "label"), "url-sample")
        vectors = VectorAssembler(inputCols=self.names, outputCol="features").transform(rows)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11, weightCol="weight", maxMemoryInMB=64).fit(vectors)
        drop(rows)
        return model

    def features(self, urls: DataFrame, url: str, host: str, path: str, query: str, names: list[str]) -> DataFrame:
        """``urls`` with the features under ``names``."""
        col = lambda c: F.col(f"`{c}`")
        plain = lexical(col(url), col(host), col(path), col(query))
        out = urls.withColumns({name: c.cast("double") for name, c in zip(names, plain.values())})
        kinds = suffixes(col(host), col(path))
        slot, alls, ones, fold = fresh(out.columns, "slot", "alls", "ones", "fold")
        for k, (kind, suffix) in enumerate(kinds.items()):
            mine = self.statistics.where(F.col("kind") == kind).select(F.col("slot").alias(slot), F.col("alls").alias(alls), F.col("ones").alias(ones))
            # SLOTS rows at most
            out = out.withColumn(slot, _slot(kind, suffix)).withColumn(fold, F.coalesce(_fold(col(url)), F.lit(0))).join(F.broadcast(mine), slot, "left")
            others = lambda c: F.coalesce(F.aggregate(col(c), F.lit(0).cast("long"), lambda a, x: a + x) - F.get(col(c), col(fold)), F.lit(0))
            n, rate = names[len(plain) + 2 * k], names[len(plain) + 2 * k + 1]
            out = out.withColumns({n: F.log1p(others(alls).cast("double")), rate: (others(ones) + F.lit(self.prior)) / (others(alls) + 1)}).drop(slot, alls, ones, fold)
        return out

    def scored(self, urls: DataFrame, url: str, host: str, path: str, query: str, score: str) -> DataFrame:
        """``urls`` with the chance that a URL is to be blocked."""
        if self.trees is None:
            return urls.withColumn(score, F.lit(float(self.prior >= 0.5)))
        columns = urls.columns
        names = fresh(columns, *self.names)
        out = self.features(urls, url, host, path, query, names)
        vector, raw, chance, guess = fresh(out.columns, "vector", "raw", "chance", "guess")
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(guess)
        out = trees.transform(VectorAssembler(inputCols=names, outputCol=vector).transform(out))
        return out.select(*[F.col(f"`{c}`") for c in columns], vector_to_array(chance)[1].alias(score))


def _ranked(labels: int, host: Column):
    """A rule as a struct by which the strongest is the largest."""
    return lambda x: F.struct(
        F.lit(labels).alias("labels"),
        F.length(x["path"]).alias("size"),
        (x["verdict"] == "allow").cast("int").alias("allow"),
        F.concat(host, x["path"]).alias("rule"),
        x["verdict"].alias("verdict"),
    )


def ruled(urls: DataFrame, host: str, path: str, rules: list[tuple[str, str, str]] | DataFrame, rule: str, verdict: str) -> DataFrame:
    """``urls`` with the rule that fits (host and path joined) and its verdict, or nulls.  rules: (host, path, verdict)."""
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict", F.size(F.split("host", "[.]")).alias("labels"))
        own = rules.groupBy("host", "labels").agg(F.collect_set(F.struct("path", "verdict")).alias("paths"))
        sizes = sorted(r.labels for r in rules.select("labels").distinct().collect())  # as many as labels a rule's host can have
    else:  # a local table, of a size that Spark knows
        held: dict[str, list] = {}
        for rule_host, rule_path, rule_verdict in rules:
            held.setdefault(rule_host, []).append({"path": rule_path, "verdict": rule_verdict})
        labels = [h.count(".") + 1 for h in held]
        kind = pa.list_(pa.struct([("path", pa.string()), ("verdict", pa.string())]))
        own = urls.sparkSession.createDataFrame(pa.table({"host": pa.array(list(held), pa.string()), "labels": pa.array(labels, pa.int32()), "paths": pa.array(list(held.values()), kind)}))
        sizes = sorted(set(labels))
    found, key, paths = fresh([*urls.columns, rule, verdict], "found", "key", "paths")
    col = lambda c: F.col(f"`{c}`")
    out = urls.withColumn(found, F.lit(None).cast("struct<labels:int,size:int,allow:int,rule:string,verdict:string>"))
    for n in sizes:
        # a host of fewer labels has no such suffix
        suffix = F.when(F.size(F.split(col(host), "[.]")) >= n, F.substring_index(col(host), ".", -n))
        mine = own.where(F.col("labels") == n).select(F.col("host").alias(key), F.col("paths").alias(paths))
        fits = F.filter(col(paths), lambda x: F.startswith(col(path), x["path"]))
        ranked = F.transform(fits, _ranked(n, col(key)))
        out = out.withColumn(key, suffix).join(mine, key, "left").withColumn(found, F.coalesce(F.array_max(ranked), col(found))).drop(key, paths)
    return out.withColumns({rule: col(found)["rule"], verdict: col(found)["verdict"]}).drop(found)


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    labelled: DataFrame | None = None,
    words: list[str] = WORDS,
    sample: int = SAMPLE,
    url: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block), score and held_out."""
    labelled = by_words(pages, url, words) if labelled is None else labelled.select("url", "label")
    model = UrlModel(labelled, sample)
    pages = pages.drop(*[c for c in pages.columns if c.lower() in OUT])
    columns = [F.col(f"`{c}`") for c in pages.columns]
    (query,) = fresh([*pages.columns, *OUT], "query")
    parts = url_parts(F.col(f"`{url}`"))
    out = pages.withColumns({"host": parts["host"], "path": parts["path"], query: parts["query"]})
    out = ruled(model.scored(out, url, "host", "path", query, "score"), "host", "path", rules, "rule", "verdict")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(*columns, "host", "path", "rule", verdict.alias("verdict"), "score", held_out(F.col("host")).alias("held_out"))
