"""License notices by exact phrases and by a set-similarity join of text blocks with templates.

Everything is DataFrame expressions. Tokens are ordered by the number of
documents that hold them, rarest first. A block (a line) that contains at least
``threshold`` of a template's distinct tokens must hold one of the template's
first ``size - need + 1`` tokens, so only those are looked up; blocks with too
few known tokens (length filter) and matches after which too few tokens are
left on either side (positional filter) go before the exact count.

A notice may be wrapped: besides lines, blocks are all runs of words, over line
breaks too, of a template's length divided by the threshold. They are counted
around the template's first tokens only, by the same prefix filter.

Null and empty texts have no words, no places and score 0. Repeated rows are
judged row by row, as are rows with equal or null keys. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupeplan.llm.common import materialize

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they are commonly written, with the label of each.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
THRESHOLD = 0.8
MATCHES = "array<struct<template:int,label:string,containment:double>>"
#: Characters between words, before A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens_of(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(UPPER, LOWER)))


def _spaced(text: Column) -> Column:
    """The words of a text, one space before, between and after them; case as it is."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, GAP, " ")), F.lit(" "))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def token_order(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> list[str]:
    """The templates' distinct tokens by the number of documents with them, rarest first, ties by token."""
    known = sorted({t for _, body in templates for t in tokens_of(body)})
    if not known:
        return []
    words = F.split(_lowered(_spaced(F.coalesce(F.col(text), F.lit("")))), " ")
    held = docs.select(F.explode(F.array_intersect(F.array(*[F.lit(t) for t in known]), words)).alias("token"))
    counts = dict.fromkeys(known, 0) | {t: n for t, n in held.groupBy("token").count().collect()}  # a row for each known token
    return sorted(known, key=lambda t: (counts[t], t))


def _run_match(number: int, label: str, own: list[str], need: int, length: int) -> Column:
    """The struct of a template (tokens by order, need of them) with the most of them that ``length`` neighbouring words of ``_wrapped`` hold, or no struct."""
    tokens, first = F.array(*[F.lit(t) for t in own]), own[: len(own) - need + 1]
    start = lambda p: F.greatest(p - length + 1, F.lit(0))
    held = lambda at, n: F.size(F.array_intersect(tokens, F.slice("_wrapped", at + 1, F.lit(n))))
    spots = F.filter(F.transform("_wrapped", lambda w, i: F.when(w.isin(first), i)), lambda p: p.isNotNull())
    near = F.filter(spots, lambda p: held(start(p), 2 * length - 1) >= need)
    most = F.array_max(F.transform(near, lambda p: F.array_max(F.transform(F.sequence(start(p), p), lambda a: held(a, length)))))
    match = F.transform(F.filter(F.array(most), lambda m: m >= need), lambda m: F.struct(F.lit(number).alias("template"), F.lit(label).alias("label"), (m / len(own)).alias("containment")))
    return F.when(F.size(F.array_intersect(tokens, F.col("_wrapped"))) >= need, match).otherwise(F.array().cast(MATCHES))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per input row with its words and phrase places, and the matches (row, block, label, containment).

    Block is the number of the line, null for the best run of words over line breaks. The first holds row (a number of the input row), the key, n_words, and
    places: an array of (phrase, start) structs.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates, text)
    index, runs = [], []
    for number, (label, body) in enumerate(templates):
        own = sorted(set(tokens_of(body)), key=order.index)
        need = max(1, math.ceil(threshold * len(own) - 1e-9))
        index += [(t, i, number, label, own, need) for i, t in enumerate(own[: len(own) - need + 1])]
        runs.append((number, label, own, need, math.ceil(len(tokens_of(body)) / threshold - 1e-9)))
    first = sorted({x[0] for x in index}, key=order.index)
    least = min((x[5] for x in index), default=1)

    whole = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(key, whole.alias("_text"), _spaced(whole).alias("_spaced"))
    seen = words.withColumn("_low", F.lower("_spaced"))
    places = F.array().cast("array<struct<phrase:string,start:bigint>>")
    for phrase in phrases:
        own = phrase.split(" ")
        at = " AND ".join(f"get(_w, i + {j}) = '{w}'" for j, w in enumerate(own))
        found = F.expr(f"transform(filter(sequence(0, greatest(size(_w) - {len(own)}, 0)), i -> {at}), i -> named_struct('phrase', '{phrase}', 'start', bigint(i)))")
        places = F.concat(places, F.when(F.contains("_low", F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<struct<phrase:string,start:bigint>>")))
    marked = F.lit(False)
    for phrase in phrases:
        marked = marked | F.contains("_low", F.lit(f" {phrase} "))
    hopeful = F.lit(False)
    for token in first:
        hopeful = hopeful | F.contains("_low", F.lit(f" {token} "))
    universe = F.array(*[F.lit(t) for t in order]) if order else F.array().cast("array<string>")
    blocks = F.filter(
        F.transform(F.split(_lowered(F.col("_text")), "\n"), lambda line, i: F.struct(i.alias("block"), F.array_intersect(universe, F.split(_spaced(line), " ")).alias("tokens"))),
        lambda x: F.size(x["tokens"]) >= least,
    )
    table = seen.select(
        F.monotonically_increasing_id().alias("row"),
        key,
        F.when(F.length("_spaced") <= 2, F.lit(0)).otherwise(F.length("_spaced") - F.length(F.replace("_spaced", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        F.when(marked, F.split(F.btrim(_lowered(F.col("_spaced"))), " ")).alias("_w"),
        F.when(hopeful, blocks).alias("blocks"),
        F.when(hopeful & F.contains("_text", F.lit("\n")), F.split(F.btrim(_lowered(F.col("_spaced"))), " ")).alias("_wrapped"),
        "_low",
    ).select("row", key, "n_words", places.alias("places"), "blocks", F.concat(F.array().cast(MATCHES), *[_run_match(*run) for run in runs]).alias("runs"))
    table = materialize(table, "licenses")

    lookup = spark.createDataFrame(index, "token string, i int, template int, label string, own array<string>, need int")
    known = table.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens")
    tokens = known.select("row", "block", "tokens", F.posexplode("tokens").alias("j", "token"))
    joined = tokens.join(lookup, "token").where(F.size("tokens") >= F.col("need"))
    bound = 1 + F.least(F.size("own") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1)
    earlier = F.expr("exists(slice(own, 1, i), t -> array_contains(tokens, t))")
    candidates = joined.where(~earlier & (bound >= F.col("need")))
    shared = candidates.withColumn("overlap", F.size(F.array_intersect("own", "tokens"))).where("overlap >= need")
    matches = shared.select("row", "block", "template", "label", (F.col("overlap") / F.size("own")).alias("containment"))
    wrapped = table.select("row", F.explode("runs").alias("r")).select("row", F.lit(None).cast("int").alias("block"), "r.template", "r.label", "r.containment")
    return table.drop("blocks", "runs"), matches.unionByName(wrapped)


def labels(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: key, n_words, places, base (labels of the phrases), more (labels of the matches) and score.

    The score is 1 with a phrase, else the largest containment of a match, else 0.
    """
    table, matches = scan(docs, key, text, phrases, templates, threshold)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    named = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    return table.join(found, "row", "left").select(
        key,
        "n_words",
        "places",
        F.array_sort(F.array_distinct(F.transform("places", lambda x: named[x["phrase"]]))).alias("base"),
        F.coalesce("more", F.array().cast("array<string>")).alias("more"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
