import random

import pytest

HEAD = "doc_id long, text string, lang string, source string, n_chars long, task int, seq string, fp string, n_words string"


def texts():
    """Keys and texts: prose, copies, near copies, repeats, junk, nulls, blanks, ties and one very long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "an", "ing", "é", "ñ", "or", "Ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    passage = prose(40)
    rows = [(i, prose(rng.randint(1, 200))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(8)]
    rows += [(60 + i, rows[20 + i][1].replace(" ", "\n", 1) + " more") for i in range(8)]
    rows += [(80 + i, prose(30) + " " + passage + "\n" + prose(20)) for i in range(6)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "word"), (94, None), (None, "no key at all"), (None, rows[3][1])]
    rows += [(95, "Some text\nReleased under the MIT License.\nlicensed, under cc by-nc 4.0!"), (96, "the MIT license and the Apache License; MIT License GENERAL public license"), (97, "a" * 700), (98, "xy " * 900)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (99, prose(6000) + passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """A stored table with columns whose names clash with those that operators make."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(k, t, "en", "src0", len(t or ""), 1, "x", "y", "z") for k, t in texts()], HEAD).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    """The same columns without rows."""
    return docs.where("doc_id = -1")
