"""URL verdicts by host and path rules, and by gradient-boosted trees on lexical features.

Parsing, features, statistics of host suffixes and scores are DataFrame
expressions; the trees become sums of conditional expressions. Only boosting
runs in numpy on the driver, on a bounded sample of distinct labelled URLs.
Statistics of suffixes count every labelled row; those that a URL is trained
with leave out all hosts of its fold, so that no URL's label is among its own
inputs.

A null URL, or one without ``://``, has an empty host and path. URLs may be of
any length. Rows are judged one by one, repeated ones alike. Without labelled
URLs of both kinds every score is the share of blocked ones (0 without any). An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import hashed_sample, hot_joined, materialize

#: Labelled URLs from which trees are boosted: those with the smallest hashes.
SAMPLE = 10_000
#: Parts of the hosts, by hash; a URL's suffix statistics in training come from the other parts.
FOLDS = 5
#: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "secure", "tld_rate", "domain_rate"]


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule, the longest that fits, and its verdict (both null without one)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def with_suffixes(pages: DataFrame) -> DataFrame:
    """Adds tld and domain (the last label of the host, and the last two), and fold (of the host)."""
    return pages.withColumns({"tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "fold": F.pmod(F.xxhash64("host", F.lit(13)), F.lit(FOLDS)).cast("int")})


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features but the suffix statistics."""
    whole = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, "\\?([^#]*)", 1)
    length = F.length(whole)
    share = lambda c: (length - F.length(F.replace(whole, c, F.lit("")))) / length
    entropy = F.aggregate(F.array_distinct(F.split(whole, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    return pages.withColumns(
        {
            "url_length": length,
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.regexp_count("path", F.lit("/")),
            "labels": F.regexp_count("host", F.lit("\\.")) + 1,
            "digit_ratio": F.regexp_count(whole, F.lit("[0-9]")) / F.greatest(length, F.lit(1)),
            "entropy": F.when(length == 0, 0.0).otherwise(entropy),
            "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
            "hyphens": F.regexp_count(whole, F.lit("-")),
            "fragment": F.contains(whole, F.lit("#")).cast("int"),
            "secure": F.startswith(whole, F.lit("https://")).cast("int"),
        }
    )


def suffix_statistics(pages: DataFrame, column: str) -> DataFrame:
    """(column, n_rows, b, n, b0, n0, ...): of every suffix its rows, and blocked and labelled rows in all and in each fold; ``blocked`` is null without a label."""
    own = lambda f: (F.col("fold") == f) & F.col("blocked").isNotNull()
    folds = [x for f in range(FOLDS) for x in (F.count_if(own(f) & (F.col("blocked") == 1)).alias(f"b{f}"), F.count_if(own(f)).alias(f"n{f}"))]
    whole = pages.groupBy(column).agg(F.count("*").alias("n_rows"), F.count_if(F.col("blocked") == 1).alias("b"), F.count("blocked").alias("n"), *folds)
    return materialize(whole, "suffixes")


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Node:
    feature: str
    cut: float
    below: Leaf | Node
    above: Leaf | Node


def _column(node: Leaf | Node) -> Column:
    if isinstance(node, Leaf):
        return F.lit(node.value)
    return F.when(F.col(node.feature) <= node.cut, _column(node.below)).otherwise(_column(node.above))


class Trees:
    """Boosted trees on binned features with the logistic loss."""

    def __init__(self, start: float, trees: list[Leaf | Node]):
        self.start, self.trees = start, trees

    @classmethod
    def boost(cls, rows: dict[str, np.ndarray], y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5, shrink: float = 1.0) -> Trees:
        if not len(y) or y.all() or not y.any():
            return cls(40.0 if len(y) and y.all() else -40.0, [])
        names = list(rows)
        cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for k, v in rows.items()}
        binned = {k: np.searchsorted(cuts[k], v, "left") for k, v in rows.items()}
        start = float(np.log(y.mean() / (1 - y.mean())))
        total, trees = np.full(len(y), start), []

        def grow(which: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Leaf | Node:
            gs, hs = g[which].sum(), h[which].sum()
            best = (1e-6, None, None)
            if left and len(which) >= 2 * least:
                for name in names:
                    own, n = binned[name][which], len(cuts[name]) + 1
                    gl, hl, cl = (np.cumsum(np.bincount(own, w, n))[:-1] for w in (g[which], h[which], np.ones(len(which))))
                    fine = (cl >= least) & (len(which) - cl >= least)
                    if fine.any():
                        gain = np.where(fine, gl**2 / (hl + shrink) + (gs - gl) ** 2 / (hs - hl + shrink) - gs**2 / (hs + shrink), -1)
                        if gain.max() > best[0]:
                            best = (float(gain.max()), name, int(gain.argmax()))
            if best[1] is None:
                leaf = Leaf(float(-rate * gs / (hs + shrink)))
                total[which] += leaf.value
                return leaf
            below = binned[best[1]][which] <= best[2]
            return Node(best[1], float(cuts[best[1]][best[2]]), grow(which[below], g, h, left - 1), grow(which[~below], g, h, left - 1))

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        return cls(start, trees)

    def column(self) -> Column:
        """Probability of a block, from columns with the features' names."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _column(tree)
        return 1 / (1 + F.exp(-total))


def _with_rates(rows: DataFrame, statistics: dict[str, DataFrame], total: int, apart: bool) -> DataFrame:
    """Adds the smoothed shares of blocked URLs; ``apart`` leaves a row's own fold out."""
    for column, table in statistics.items():
        names = rows.columns
        b, n = F.col("b"), F.col("n")
        for f in range(FOLDS) if apart else ():
            b, n = F.when(F.col("fold") == f, F.col("b") - F.col(f"b{f}")).otherwise(b), F.when(F.col("fold") == f, F.col("n") - F.col(f"n{f}")).otherwise(n)
        rows = hot_joined(rows, table, column, "n_rows", total).select(*names, ((b + 1) / (n + 2)).alias(f"{column}_rate"))
    return rows


def trained(known: DataFrame, statistics: dict[str, DataFrame], total: int, url: str, sample: int) -> Trees:
    """Trees from labelled rows (url, blocked): at most ``sample`` distinct ones."""
    chosen = hashed_sample(known.select(url, "blocked").distinct(), F.col(url), sample)
    rows = with_features(_with_rates(with_suffixes(parsed(chosen, url)), statistics, total, True), url)
    got = rows.select("blocked", *[F.col(k).cast("double").alias(k) for k in FEATURES]).orderBy("blocked", *FEATURES).collect()
    return Trees.boost({k: np.array([r[k] for r in got], float) for k in FEATURES}, np.array([r["blocked"] for r in got], float))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per row: key, host, path, rule, verdict and score (the method's probability of a block).

    ``labelled`` has url and blocked (0 or 1); by default the URLs that a rule
    judges are the labelled ones.
    """
    trees, statistics, total = learn(pages, url, rules, labelled, sample)
    found = with_suffixes(ruled(parsed(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url"), rules))
    scored = with_features(_with_rates(found, statistics, total, False), "_url").withColumn("score", trees.column())
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


def learn(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> tuple[Trees, dict[str, DataFrame], int]:
    """(trees, statistics by suffix, number of rows counted); see ``judge``."""
    found = ruled(parsed(pages.select(F.col(url).alias("_url")), "_url"), rules)
    if labelled is None:
        every = found.select("_url", "host", F.when(F.col("rule").isNotNull(), (F.col("rule_verdict") == "block").cast("int")).alias("blocked"))
    else:
        known = labelled.where(F.col("blocked").isin(0, 1)).select(F.col(url).alias("_url"), F.col("blocked").cast("int").alias("blocked"))
        every = found.select("_url", "host", F.lit(None).cast("int").alias("blocked")).unionByName(parsed(known, "_url").select("_url", "host", "blocked"))
    counted = with_suffixes(every)
    statistics = {c: suffix_statistics(counted, c) for c in ("tld", "domain")}
    total = statistics["tld"].agg(F.sum("n_rows")).first()[0] or 0
    return trained(every.where("blocked IS NOT NULL"), statistics, total, "_url", sample), statistics, total
