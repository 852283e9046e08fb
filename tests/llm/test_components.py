import random
from collections import defaultdict

from rankledger.llm.components import components


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def check(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], "l string, r string, _v int, name string")
    groups = defaultdict(set)
    for r in components(df, "l", "r").collect():
        groups[r["_c"]].add(r["name"])
    assert {frozenset(g) for g in groups.values()} == brute(pairs)


def test_chain_star_loops_and_nulls(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(200)]
    check(spark, chain + star * 2 + [("x", "x"), (None, "a"), ("b", None), ("", "blank"), ("x y", "é")])


def test_random_graph(spark):
    r = random.Random(3)
    check(spark, [(f"k{r.randrange(400)}", f"m{r.randrange(400)}") for _ in range(300)])


def test_empty(spark):
    check(spark, [])
