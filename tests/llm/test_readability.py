import os

import pyarrow as pa
import pytest

from rankledger.llm.readability import COUNTS, count_texts, cross_validated, fit, reading_levels

EASY = "The cat sat. We saw a dog. It ran to me. I like my hat. "
HARD = "Notwithstanding considerable institutional resistance, interdisciplinary collaboration facilitated comprehensive organisational transformation throughout metropolitan administrations. "


def test_counts(spark):
    got = [dict(zip(COUNTS, map(int, r))) for r in count_texts(pa.array([EASY, "Page 1 of 2\nThe radiant people created it in 3 days! Yes?\n***", None, "", "...", "ÉTÉ"])).tolist()]
    assert (got[0]["words"], got[0]["sentences"], got[0]["syllables"], got[0]["hard_words"]) == (15, 4, 15, 0)
    assert (got[1]["words"], got[1]["sentences"], got[1]["hard_words"]) == (8, 2, 2)
    assert all(got[i]["words"] == 0 for i in (2, 3, 4)) and got[5]["words"] == 1


def test_short_lines_and_entities():
    prose = "Rules of the Open\nThe judges &amp; coaches met. They read [the rules] and/or spoke."
    counts = lambda text, short: dict(zip(COUNTS, map(int, count_texts(pa.array([text]), short)[0].tolist())))
    assert (counts(prose, 120)["words"], counts(prose, 120)["sentences"]) == (11, 2)
    assert counts(prose, 0)["words"] == 15
    assert counts("Rules of the Open\nPage 1", 120)["words"] == 5  # no line of prose: counted whole


def test_cross_validation_reports_both_coefficients(spark):
    anchors = spark.createDataFrame([(i, EASY * (i % 3 + 2) if i % 2 else HARD * (i % 3 + 2), 1 if i % 2 else 5) for i in range(40)], "k int, text string, level int")
    got = {(k, e): (n, r) for k, e, n, r in cross_validated(anchors, "text", "level", "k")}
    assert len(got) == 13 and got["published", "median"] == got["refitted", "median"] == (40, 40)
    assert cross_validated(anchors.where("k > 99"), "text", "level", "k") == []


def test_blocks_do_not_change_counts():
    from rankledger.llm import readability

    texts = pa.array([EASY * 9, None, HARD * 5, "x", EASY + "\n" + HARD] * 7)
    whole = count_texts(texts)
    kept, readability.BLOCK = readability.BLOCK, 100
    try:
        assert (count_texts(texts) == whole).all() and (count_texts(texts.slice(3, 11)) == whole[3:14]).all()
    finally:
        readability.BLOCK = kept


def test_levels_nulls_and_clashing_columns(spark):
    anchors = spark.createDataFrame([(i, EASY * (i % 3 + 2) if i % 2 else HARD * (i % 3 + 2), 1 if i % 2 else 5) for i in range(20)] + [(90, None, 3), (91, "x", None)], "k int, text string, level int")
    model = fit(anchors, "text", "level", "k")
    docs = spark.createDataFrame([(1, EASY * 10, "a"), (2, HARD * 10, "b"), (3, None, "c"), (4, "", "d"), (5, "123", "e"), (1, EASY * 10, "a")], "id int, text string, words string")
    got = [(r["id"], r["reading_level"], r["words"]) for r in reading_levels(docs, "text", model).collect()]
    assert sorted(got) == [(1, 1, "a"), (1, 1, "a"), (2, 5, "b"), (3, None, "c"), (4, None, "d"), (5, None, "e")] or sorted(got, key=lambda x: x[0]) == [(1, 1, "a"), (1, 1, "a"), (2, 5, "b"), (3, None, "c"), (4, None, "d"), (5, None, "e")]
    assert reading_levels(docs.where("id > 9"), "text", model).collect() == []
    assert {r["reading_level"] for r in reading_levels(docs, "text", fit(anchors.where("k > 50"), "text", "level", "k")).collect()} == {None}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the anchors")
def test_held_out_accuracy(spark):
    anchors = spark.read.parquet("/root/testdata/sf0.001/reading_anchors.parquet")
    right = total = 0
    for k in range(3):
        fold = "pmod(xxhash64(anchor_id), 3)"
        model = fit(anchors.where(f"{fold} <> {k}"), "text", "reading_level", "anchor_id")
        test = anchors.where(f"{fold} = {k}").withColumnRenamed("reading_level", "want")
        for r in reading_levels(test, "text", model).select("want", "reading_level").collect():
            right, total = right + (r["want"] == r["reading_level"]), total + 1
    assert total == anchors.count() and right / total >= 0.95


def test_weighted_median_in_spark_and_numpy(spark):
    import random

    import numpy as np

    from rankledger.llm import readability as R

    r = random.Random(5)
    words = (EASY + HARD).split()
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(20, 90))) + "." for _ in range(60)]
    anchors = spark.createDataFrame([(i, t, 1 + i % 5) for i, t in enumerate(texts)], "k int, text string, level int")
    model = fit(anchors, "text", "level", "k")
    assert abs(sum(model.weights.values()) - 1) < 1e-9
    for row in reading_levels(anchors, "text", model).collect():
        e, w = np.array([row[f"{n}_estimate"] for n in R.FORMULAS]), np.array([model.weights[n] for n in R.FORMULAS])
        assert abs(R._weighted_median(e[:, None], w)[0] - row["median_estimate"]) < 1e-9
        below, above = w[e < row["median_estimate"] - 1e-12].sum(), w[e > row["median_estimate"] + 1e-12].sum()
        assert below < 0.5 + 1e-9 and above <= 0.5 + 1e-9


def test_columns_of_any_name(spark):
    anchors = spark.createDataFrame([(i, EASY * 3 if i % 2 else HARD * 3, 1 if i % 2 else 5) for i in range(8)], "k int, text string, level int")
    docs = spark.createDataFrame([(1, EASY * 9, "p", "q", 9, "r", "s")], "id int, words string, _counts string, _wps string, reading_level int, `a.b` string, c0 string")
    got = reading_levels(docs, "words", fit(anchors, "text", "level", "k"))
    assert got.columns[:5] == ["id", "_counts", "_wps", "a.b", "c0"] and len(got.columns) == len(set(got.columns))
    row = got.first()
    assert (row["_counts"], row["_wps"], row["a.b"], row["c0"], row["reading_level"]) == ("p", "q", "r", "s", 1)
