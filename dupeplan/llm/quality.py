"""Quality rules: word and line statistics, and decision lists learned from them.

All of the data path is DataFrame expressions. The list is grown on the driver
from a bounded sample of labelled statistics of rows that pass the base rule, by
sequential covering: conditions are added to a conjunction while they gain
information on two thirds of the sample, each threshold halfway between the
values that it parts. The conjunction is pruned to that subset of its conditions
that does best on the other third, and becomes a rule if it is precise enough
there. What it covers, or what it was grown for in vain, is set aside before the
next one. The rules become one ordered conditional expression.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged row by row. An empty table gives an empty result; without labels of both
kinds no rule is learned and the base rule alone decides. Texts may be of any
length. Columns of the input that have the name of an added one give way to it;
all others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import hashed_sample

#: Labelled rows from which a list is learned: those with the smallest hashed keys.
SAMPLE = 6000
SPACE = " \t\n\x0b\x0c\r"
#: Features that rules may test, from the statistics.
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_digits and n_marks.

    Three-word windows are compared by their 64-bit hashes within a text.
    """
    out = [c for c in docs.columns if c not in STATISTICS]
    whole = F.coalesce(F.col("_text"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    parts = docs.select(F.struct(*out).alias("_row"), F.col(text).alias("_text")).select(
        "_row",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("_words"),
        lines.alias("_lines"),
        *[F.regexp_count(whole, F.lit(p)).cast("long").alias(c) for c, p in {"n_symbols": "[#*$%&|<>]", "n_upper": "[A-Z]", "n_digits": "[0-9]", "n_marks": "[!?]"}.items()],
    )
    windows = F.expr("CASE WHEN size(_words) < 3 THEN array() ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END").cast("array<bigint>")
    counted = parts.select(
        "_row",
        "n_symbols",
        "n_upper",
        "n_digits",
        "n_marks",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    ordered = "sort_array(transform(_windows, (h, i) -> struct(h, i)))"
    ranked = counted.withColumn("_ranked", F.expr(f"CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN {ordered} END")).drop("_windows")
    twice = "sort_array(transform(filter(_ranked, (x, k) -> x.h <=> get(_ranked, k - 1).h OR x.h <=> get(_ranked, k + 1).h), x -> x.i))"
    covered = f"aggregate({twice}, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"
    repeated = F.expr(f"CASE WHEN _ranked IS NULL THEN 0L ELSE {covered} END").alias("n_repeat_words")
    # One generated row for each: a filter on the statistics stays above it, else the optimizer would write them out again for every use.
    return ranked.select(*[F.col("_row")[c].alias(c) for c in out], F.inline(F.array(F.struct(*[c for c in STATISTICS if c != "n_repeat_words"], repeated))))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_digits", "n_marks", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, op, cut in self.conditions:
            value = F.expr(FEATURES[name])
            found = found & (value <= cut if op == "<=" else value > cut)
        return found

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(next(iter(rows.values()))), bool)
        for name, op, cut in self.conditions:
            found &= rows[name] <= cut if op == "<=" else rows[name] > cut
        return found


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, good: np.ndarray, cuts: int, longest: int) -> list[tuple[str, str, float]]:
    """Conditions that part the bad rows from the good ones."""
    live, conditions = bad | good, []
    while len(conditions) < longest and (live & good).any():
        p, n = (live & bad).sum(), (live & good).sum()
        if not p:
            break
        best = (1e-9, None, None)
        for name, values in rows.items():
            known = np.unique(values[live])
            for cut in np.unique(np.quantile(values[live], np.linspace(0, 1, cuts + 1))):
                for op, side in (("<=", values <= cut), (">", values > cut)):
                    now = live & side
                    p1, n1 = (now & bad).sum(), (now & good).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0]:
                            below, above = known[known <= cut], known[known > cut]
                            middle = float(below[-1] + above[0]) / 2 if len(below) and len(above) else float(cut)
                            best = (gain, (name, op, middle), now)
        if best[1] is None:
            break
        conditions.append(best[1])
        live = best[2]
    return conditions


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.98, most: int = 12, cuts: int = 24, longest: int = 4) -> list[Rule]:
    """Decision list for ``bad`` by sequential covering; ``fold`` marks the rows that prune. At most ``most`` rules are tried."""
    rules, left, wanted = [], np.ones(len(bad), bool), bad.copy()
    for _ in range(most):
        grow = left & ~fold
        if (grow & wanted).sum() < 3:
            break
        conditions = _grow({k: v[grow] for k, v in rows.items()}, wanted[grow], ~bad[grow], cuts, longest)
        if not conditions:
            break
        scored = []
        for chosen in (c for n in range(1, len(conditions) + 1) for c in combinations(conditions, n)):
            rule = Rule(chosen)
            hit = rule.covers(rows) & left & fold
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            scored.append(((p - n) / (p + n) if p + n else -1.0, p, -len(chosen), rule))
        rule = max(scored, key=lambda x: x[:3])[3]
        hit = rule.covers(rows) & left
        if (hit & bad & fold).any() and all((hit & bad & part).sum() >= precision * (hit & part).sum() for part in (fold, ~fold)):
            rules.append(rule)
            left &= ~hit
        else:
            wanted &= ~Rule(tuple(conditions)).covers(rows)
    return rules


def base_failed() -> Column:
    """The base rule, on the statistics: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learns the list that rejects rows labelled 0 that pass the base rule, from at most ``sample`` labelled keys (and rows)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = hashed_sample(known, F.col("_key"), sample)
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).alias("_body")).join(F.broadcast(chosen), "_key")
    passed = with_statistics(labelled, "_body").where(~base_failed())
    found = passed.select("_key", "_label", *[F.expr(e).alias(k) for k, e in FEATURES.items()], (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(3)) == 0).alias("_fold"))
    got = found.orderBy("_key").limit(sample).collect()
    bad = np.array([r["_label"] == 0 for r in got], bool)
    if not bad.any() or bad.all():
        return []
    return learn({k: np.array([r[k] for r in got], float) for k in FEATURES}, bad, np.array([r["_fold"] for r in got], bool))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, base_failed, rule (number of the first rule that fires, else 0) and kept."""
    fired = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(rule.column(), F.lit(number)).otherwise(fired)
    judged = with_statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": fired})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
