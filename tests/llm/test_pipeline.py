"""The pipeline's stages by row, against brute force, over ids that repeat, nulls, blanks, long texts and clashing columns."""

import random
from collections import Counter

import pytest
from test_operators import components, contamination, features, fingerprint, repeats

import corpus_pipeline as pipeline
from dupeplan.llm import quality
from dupeplan.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, n_words int, who string"
BENCHMARK = " ".join(f"item{i}" for i in range(30))


def prose(rng, n):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 900)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = {x: prose(rng, rng.randint(60, 200)) for x in "ABCDEFGHIJ"}
    passage = prose(rng, 70)
    found = [(2, texts["A"]), (5, texts["A"]), (5, texts["B"]), (7, texts["C"]), (7, texts["D"]), (None, texts["E"]), (None, texts["A"]), (9, texts["F"]), (9, texts["F"])]
    found += [(11, None), (12, ""), (13, " \n\t"), (14, "few words"), (None, None)]
    found += [(20 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for i in range(4)]
    found += [(30, texts["G"] + " " + BENCHMARK), (30, texts["H"]), (31, prose(rng, 9000) + " " + passage), (32, "# $ % & " * 40 + texts["I"]), (40, texts["J"] + " é" * 30)]
    return [(k, t, "en", "src0", len(t or ""), "mine", "mine", 777, "mine") for k, t in found]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0), (7, 1, 0), (32, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def taken(df):
    return [tuple(r) for r in df.collect()]


def test_quality_stage(spark, tables, rows, monkeypatch):
    rule = quality.Rule((("symbols_per_word", ">", 0.5),))
    monkeypatch.setattr(quality, "learn_rules", lambda *_: [rule])
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = pipeline.quality_rules(spark, docs, tables)
    assert got.columns == docs.columns
    want = [r for r in rows if not features(r[1])[1] and features(r[1])[0]["symbols_per_word"] <= 0.5]
    assert Counter(taken(got)) == Counter(want) and 0 < len(want) < len(rows) - 5


def test_near_duplicates_stage(spark, tables, rows):
    """One row of each group stays, the smallest id's; no row of another group goes with it because ids repeat."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = taken(pipeline.near_duplicates(spark, docs, tables))
    root = components([fingerprint(t) for _, t, *_ in rows], 4)
    groups = {}
    for r in rows:
        groups.setdefault(root[fingerprint(r[1])], []).append(r)
    assert len(got) == len(groups) and not Counter(got) - Counter(rows)
    by_root = {root[fingerprint(r[1])]: r for r in got}
    assert len(by_root) == len(groups)
    for key, members in groups.items():
        ids = [r[0] for r in members]
        assert by_root[key][0] == min((i for i in ids if i is not None), default=None)
    kept = [(r[0], r[1]) for r in got]
    assert all((k, rows[i][1]) in kept for i, k in ((0, 2), (2, 5), (3, 7), (4, 7), (5, None)))


def test_repeated_strings_stage(spark, tables, rows):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = taken(pipeline.repeated_strings(spark, docs, tables))
    stored = [tuple(r) for r in docs.collect()]
    want = []
    for r, (_, _, _, spans, _) in zip(stored, repeats([r[:2] for r in stored], 100), strict=True):
        raw, at, left = (r[1] or "").encode(), 0, b""
        for a, b in [*spans, (len(raw), 0)]:
            left += raw[at:a]
            at = b
        text = left.decode("utf-8", "ignore")
        want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    assert Counter(got) == Counter(want)


def test_benchmark_stage(spark, tables, rows):
    """Only the row that holds the item goes, not the other one with its id."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = taken(pipeline.clean_of_benchmark(spark, docs, tables))
    found = contamination([(i, r[1]) for i, r in enumerate(rows)], [(1, BENCHMARK), (2, None)])
    want = [rows[i] for i, n, hit, _ in found if not (hit and 20 * hit >= n)]
    assert Counter(got) == Counter(want) and len(want) == len(rows) - 1


def test_whole_pipeline(spark, tables, rows):
    pieces = pipeline.run(spark, tables).collect()
    known = {r[0] for r in rows}
    assert pieces and {p["doc_id"] for p in pieces} <= known and {11, 12, 13, 14} & {p["doc_id"] for p in pieces} == set()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, tables), "stage")
    assert sum(p["length"] for p in pieces) == sum(p["length"] for p in pipeline.packed_sequences(spark, docs, tables).collect())


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id = -1")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, tables).isEmpty()
