"""The registered queries' columns, types and digests over small tables, against brute force."""

import hashlib
import zlib
from collections import Counter

import pytest
from test_operators import PAGES, contamination, fingerprint, letters, repeats, revisits, spaced, tally

from dupeplan.llm import license, queries

ITEMS = [(1, None), (10, "the MIT license and the Apache License"), (9, "word"), (3, "...")]


@pytest.fixture(scope="module")
def tables(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contracts"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*ITEMS, (4, rows[3][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def test_op1(spark, tables, rows):
    got = queries.op1_simhash(spark, tables)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert tally((r["doc_id"], r["fingerprint"]) for r in got.collect()) == tally((k, f"{fingerprint(t):016x}") for k, t in rows)


def test_op2(spark, tables, rows):
    got = queries.op2_lm_scoring(spark, tables)
    types = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    assert dict(got.dtypes) == types
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    total = sum(len(spaced(t)) + 1 for k, t in rows if not held(k))
    want = tally((k, held(k), len(spaced(t)) + 1, total) for k, t in rows)
    assert tally((r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) for r in got.collect()) == want


def test_op3(spark, tables, rows):
    got = queries.op3_packing(spark, tables)
    assert [c for c, t in got.dtypes if t == "bigint"][:8] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
    assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter(k for k, _ in rows)


def test_op4(spark, tables, rows):
    items = [*ITEMS, (4, rows[3][1])]
    want = []
    for k, n, hit, found in contamination(rows, items):
        want.append((k, n, hit, len(found.split(",")) if found else 0, hashlib.sha256(found.encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    got = queries.op4_decontaminate(spark, tables).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "bigint", "string", "boolean"]
    assert tally(tuple(r) for r in got.collect()) == tally(want) and any(x[5] for x in want)


def test_op5(spark, tables):
    got = queries.op5_url_filter(spark, tables).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(r["page_id"] for r in got) == Counter(k for k, *_ in PAGES) and {r["verdict"] for r in got} <= {"allow", "block"}


def test_op6(spark, tables):
    stored = [tuple(r) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    got = queries.op6_warc(spark, tables)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert tally(tuple(r) for r in got.collect()) == tally(revisits(stored))


def test_op7(spark, tables, rows):
    want = []
    for k, t in rows:
        w, places, base = letters(t), [], set()
        for phrase, label in license.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places, base = places + at, base | ({label} if at else set())
        want.append((k, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))))
    got = queries.op7_license_scan(spark, tables).collect()
    assert tally(tuple(r)[:6] for r in got) == tally(want)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
        assert 0 <= r["score"] <= 1


def test_op8(spark, tables, rows):
    got = queries.op8_quality_rules(spark, tables)
    assert [t for _, t in got.dtypes[:8]] == ["bigint"] * 6 + ["boolean"] * 2
    found = got.collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in found) == Counter((k, len(spaced(t))) for k, t in rows)
    assert all(not r["kept"] for r in found if r["base_failed"]) and all(r["kept"] == (not r["base_failed"] and not r["rule"]) for r in found)


def test_op9(spark, tables, rows):
    got = queries.op9_suffix_dedup(spark, tables)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    stored = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert tally(tuple(r) for r in got.collect()) == tally((k, n, gone, len(spans), h) for k, n, gone, spans, h in repeats(stored, 100))
