import random
from decimal import Decimal

import pytest

from rankledger.llm.topn import top_n

SCHEMA = "g string, i string, a int, b int, _code string, position int"


def brute(rows, n):
    low = -(10**10)
    best = {}
    for g, i, a, b, *_ in rows:
        if g is None or i is None:
            continue
        key = (low if a is None else a, low if b is None else b)
        best[g, i] = max(best.get((g, i), (low * 2, 0)), key)
    out = set()
    for g in {k[0] for k in best}:
        ranked = sorted(((-s[0], -s[1], i.encode()) for (h, i), s in best.items() if h == g))
        out |= {(g, i.decode(), p + 1) for p, (_, _, i) in enumerate(ranked[:n])}
    return out


def check(spark, rows, n, fanout):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {(r["g"], r["i"], r["position"]) for r in top_n(df, "g", "i", ["a", "b"], n, fanout).collect()}
    assert got == brute(rows, n)


def test_random_with_ties_nulls_and_repeats(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", "z", None]), r.choice([None, *(f"id{k}" for k in range(60))]), r.choice([None, -5, 0, 1, 2]), r.choice([None, 7, 7, -(2**31)])) for _ in range(800)]
    rows += [("one", "k", 1, 1)] * 3
    check(spark, rows, 5, 4)


def test_one_tie_of_all_and_prefix_identifiers(spark):
    rows = [("g", "a" * k, 3, None) for k in range(1, 40)] + [("g", "a\0" * k, 3, None) for k in range(1, 10)] + [("g", "é", 3, None), ("g", "z", 3, None), ("g", "", 3, None)]
    check(spark, rows, 7, 2)


def test_wide_scores_and_empty(spark):
    rows = [("g", f"i{k}", (-1) ** k * (2**31 - 1 - k), k * 10**6) for k in range(30)]
    check(spark, rows, 3, 64)
    check(spark, [], 3, 64)
    check(spark, [("g", "i", None, None), ("g", "j", None, None)], 1, 64)


def test_fractional_scores_are_not_rounded(spark):
    def order(kind, values, n=9):
        df = spark.createDataFrame([("g", i, v) for i, v in zip("abcdefghij", values)], f"g string, i string, s {kind}")
        return "".join(r["i"] for r in sorted(top_n(df, "g", "i", ["s"], n).collect(), key=lambda r: r["position"]))

    assert order("double", [1.4, 1.1, 1.2, 0.6], 2) == "ac"
    assert order("double", [-0.5, None, float("-inf"), 0.0, -0.0, 1e-300, float("inf"), -1e300]) == "gfdeahcb"
    assert order("float", [1.5, 1.25, 1.75]) == "cab"
    assert order("decimal(12,4)", [Decimal("-0.05"), Decimal("1.0001"), Decimal("1.0002"), None, Decimal("-7")]) == "cbaed"
    assert order("bigint", [2**63 - 1, -(2**63), 0]) == "acb"
    with pytest.raises(TypeError):
        order("string", ["x", "y"])
