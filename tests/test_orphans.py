from datetime import datetime

from rankledger.operators.orphans import Reference, find_orphans, orphan_report

D = datetime


def frame(spark, rows, ref):
    return spark.createDataFrame(rows, f"id string, {ref} string, ingested_at timestamp_ntz, depth int, orphan_kind string")


def rows(df):
    return sorted((r["child_table"], r["row_id"], r["field_name"], r["orphan_kind"], r["period"], r["depth"]) for r in df.collect())


REFS = [Reference("c", "p", "b"), Reference("b", "p", "a")]


def tables(spark, a, b, c):
    pad = lambda xs: [(*x, 1, "x") for x in xs]
    return {"a": frame(spark, pad(a), "p"), "b": frame(spark, pad(b), "p"), "c": frame(spark, pad(c), "p")}


def tomb(spark, xs):
    return spark.createDataFrame(xs, "parent_table string, row_id string, deleted_at timestamp_ntz")


def test_kinds_repeats_nulls_and_cascade(spark):
    t1, t2, t3 = D(2020, 1, 5), D(2020, 2, 5), D(2021, 3, 5)
    a = [("a1", None, t2), ("a1", None, t3), ("a2", None, t1)]
    b = [("b1", "a1", t1), ("b1", "a1", t3), ("b2", "gone", t2), ("b3", "a2", t2), ("b4", None, t2), ("b5", "", t2), (None, "gone", t2)]
    c = [("c1", "b2", t3), ("c2", "b3", t3), ("c3", "b1", t3), ("c4", "b9", None), ("c4", "b9", t3), ("c5", "b4", None)]
    got = rows(find_orphans(tables(spark, a, b, c), REFS, tomb(spark, [("a", "a2", None), ("b", "a1", t1), ("a", None, t1)])))
    assert got == sorted([
        ("b", "b1", "p", "late", "2020-01", 0), ("b", "b2", "p", "missing", "2020-02", 0), ("b", "b3", "p", "deleted", "2020-02", 0), ("b", "b5", "p", "missing", "2020-02", 0),
        ("c", "c4", "p", "missing", "2021-03", 0), ("c", "c1", "p", "inherited", "2021-03", 1), ("c", "c2", "p", "inherited", "2021-03", 1)])


def test_empty_tables(spark):
    got = find_orphans(tables(spark, [], [], []), REFS, tomb(spark, []))
    assert got.collect() == [] and orphan_report(got).collect() == []


def test_cycle_ends(spark):
    t = D(2020, 1, 1)
    x = {"n": frame(spark, [("1", "2", t, 0, ""), ("2", "1", t, 0, ""), ("3", "9", t, 0, ""), ("4", "3", t, 0, ""), ("5", "4", t, 0, "")], "p")}
    got = rows(find_orphans(x, [Reference("n", "p", "n")], tomb(spark, [])))
    assert [(r[1], r[3], r[5]) for r in got] == [("3", "missing", 0), ("4", "inherited", 1), ("5", "inherited", 2)]
