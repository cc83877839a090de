"""The pipeline's stages judge rows: null and repeated ids, clashing texts of one id, empty tables."""

import random

import pytest

pytest.importorskip("lorekeep.llm")

from lorekeep.llm import decontaminate, minhash, quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, own_id int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS)


def sentence(r, n):
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def told(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_contaminated_rows_go_whatever_their_id(spark):
    r = random.Random(1)
    leak, clean = sentence(r, 12), sentence(r, 30)
    bench = spark.createDataFrame([(1, leak), (2, sentence(r, 40)), (None, clean), (3, "")], "item_id long, text string")
    rows = [(1, clean), (1, f"a {leak} b"), (None, clean), (None, leak), (2, None), (2, ""), (2, leak), (3, clean), (3, clean)]
    want = sorted([(1, clean), (None, clean), (2, None), (2, ""), (3, clean), (3, clean)], key=repr)
    for size in (1 << 20, 100):
        got = decontaminate.clean(docs(spark, *rows), bench, block_bytes=size)
        assert told(got) == want and got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert decontaminate.clean(docs(spark).limit(0), bench).count() == 0


def test_near_copies_of_rows_without_or_with_repeated_ids(spark):
    r = random.Random(2)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    near = a + " one more"
    rows = [(5, a), (5, b), (1, a), (9, c), (9, c), (None, d), (None, d), (None, near), (7, None), (7, None), (8, ""), (None, "")]
    got = minhash.without_near_copies(docs(spark, *rows), 5, 80)
    assert told(got) == sorted([(5, b), (1, a), (9, c), (None, d), (7, None), (8, ""), (None, "")], key=repr)
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    plain = minhash.without_near_copies(docs(spark, (3, a), (2, near), (4, b), (6, None)), 5, 80)
    assert told(plain) == sorted([(2, near), (4, b), (6, None)], key=repr)
    assert minhash.without_near_copies(docs(spark).limit(0), 5, 80).count() == 0


def test_rejected_rows_go_whatever_their_id(spark):
    r = random.Random(3)
    good = [(i, sentence(r, 40)) for i in range(60)]
    bad = [(100 + i, "zz !!! " * 12 + sentence(r, 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    junk, fine = "zz !!! " * 12, sentence(r, 40)
    rows = [*good, *bad, (None, junk), (None, fine), (500, junk), (500, fine), (None, None), (3, good[3][1])]
    got = told(quality.keep_good(docs(spark, *rows), labels))
    assert got == sorted([*good, (None, fine), (500, fine), (3, good[3][1])], key=repr)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs(spark).limit(0), none).count() == 0
