import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankledger.llm.fusion import Fusion, fuse, value_posteriors

SCHEMA = "g string, id string, src string, t long, name string, rule string, _val string, records int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_precedence_blank_fields_and_repeats(spark):
    rows = [("e", "r1", "s1", 5, " ", None), ("e", "r2", "s2", 4, "Open", ""), ("e", "r2", "s2", 4, "Open", ""), ("e", "r3", None, None, "Other", "rule-1"), (None, "n1", "s1", 1, None, None), (None, "n2", "s1", 1, None, None)]
    got = {r["g"]: r for r in fuse(frame(spark, rows), ["g"], "id", "src", "t", ["name", "rule"], [F.col("id")]).collect()}
    e = got["e"]
    assert (e["surviving_id"], e["name"], e["name_from"], e["rule"], e["rule_from"], e["records"]) == ("r1", "Open", "r2", "rule-1", "r3", 3)
    assert (got[None]["surviving_id"], got[None]["name"], got[None]["name_from"], got[None]["records"]) == ("n1", None, None, 2)


def test_copied_votes_are_discounted(spark):
    rows = []
    for k in range(60):  # a source errs and two copy it: four honest sources show it in two thirds of the groups, two are outvoted in the rest
        g = f"g{k}"
        honest = ["honest1", "honest2", "honest3", "honest4"] if k % 3 else ["honest1", "honest2"]
        rows += [(g, f"{g}-{s}", s, 1 + i, f"true{k}", None) for i, s in enumerate(honest)]
        rows += [(g, f"{g}-{s}", s, 10 + i, f"wrong{k}", None) for i, s in enumerate(["orig", "copy1", "copy2"])]
    df = frame(spark, rows)
    got = {r["g"]: r["name"] for r in fuse(df, ["g"], "id", "src", "t", ["name"], model=Fusion(rounds=5)).collect()}
    post, accuracy, copies = value_posteriors(df, ["g"], "id", "src", "t", ["name"], Fusion(rounds=5))
    dep = {(r["_src"], r["_orig"]): r["_dep"] for r in copies.df.collect()}
    assert dep["copy1", "orig"] > 0.9
    acc = {r["_src"]: r["_acc"] for r in accuracy.df.collect()}
    assert acc["honest1"] > acc["orig"]
    assert all(v == f"true{g[1:]}" for g, v in got.items())


def test_empty(spark):
    assert fuse(frame(spark, []), ["g"], "id", "src", "t", ["name"]).collect() == []


def test_a_superseded_value_loses(spark):
    rows = [("g", "a1", "A", 1, "old", None), ("g", "a2", "A", 2, "new", None), ("g", "b1", "B", 3, "new", None), ("h", "a3", "A", 1, "old", None), ("h", "a4", "A", 2, "new", None)]
    got = {r["g"]: r for r in fuse(frame(spark, rows), ["g"], "id", "src", "t", ["name"]).collect()}
    assert got["g"]["name"] == got["h"]["name"] == "new" and got["g"]["name_posterior"] > 0.5 and got["h"]["name_from"] == "a4"


def brute(rows, m):
    """(group -> (value, posterior)) of one field by loops over claims; rows as in frame(), record ids distinct."""
    claims = {}
    for g, rid, src, t, val, _ in sorted(rows, key=lambda r: (-(2**62 if r[3] is None else r[3]), r[1]), reverse=True):
        if val and val.strip():
            claims[g, src or ""] = (2**62 if t is None else t, val)
    by_value, by_group = defaultdict(list), defaultdict(list)
    for (g, src), (t, val) in claims.items():
        by_value[g, val].append((t, src))
        by_group[g].append((t, src, val))
    accuracy, dep = defaultdict(lambda: m.first_accuracy), {}

    def posteriors():
        out = {}
        for g, said in by_group.items():
            votes = {}
            for v in {x[2] for x in said}:
                first = min(by_value[g, v])[1]
                votes[v] = sum(math.log(m.false_values * accuracy[s] / (1 - accuracy[s])) * (1 if s == first else 1 - m.copy_share * dep.get((s, first), 0.0)) for _, s in by_value[g, v])
            z = sum(math.exp(x) for x in votes.values()) + max(m.false_values + 1 - len(votes), 0)
            out |= {(g, v): math.exp(x) / z for v, x in votes.items()}
        return out

    for _ in range(m.rounds):
        post = posteriors()
        hits = defaultdict(list)
        for (g, src), (_, v) in claims.items():
            hits[src].append(post[g, v])
        new = {s: min(max((sum(h) + m.smoothing * m.first_accuracy) / (len(h) + m.smoothing), m.bounds[0]), m.bounds[1]) for s, h in hits.items()}
        moved = max(abs(new[s] - accuracy[s]) for s in new)
        met = defaultdict(lambda: [0.0, 0.0, 0.0])
        for (g, src), (_, v) in claims.items():
            first, (_, lead, lead_val) = min(by_value[g, v])[1], min(by_group[g])
            if src != first:
                met[src, first][0] += post[g, v]
                met[src, first][1] += 1 - post[g, v]
            if src != lead and v != lead_val:
                met[src, lead][2] += 1
        accuracy, dep = new, {}
        for (s, o), (kt, kf, kd) in met.items():
            a1, a2, c = new[s], new[o], m.copy_share
            pt, pf = a1 * a2, (1 - a1) * (1 - a2) / m.false_values
            odds = math.log(m.copy_prior / (1 - m.copy_prior)) + kt * math.log((a2 * c + pt * (1 - c)) / pt) + kf * math.log(((1 - a2) * c + pf * (1 - c)) / pf) + kd * math.log(1 - c)
            dep[s, o] = 1 / (1 + math.exp(-min(max(odds, -50), 50)))
        if moved <= m.tolerance:
            break
    post, best = posteriors(), {}
    for (g, v), p in post.items():
        best[g] = min(best.get(g, (9, "")), (-p, v))
    return {g: (v, -p) for g, (p, v) in best.items()}


@pytest.mark.parametrize("seed,rounds", [(1, 6), (2, 1)])
def test_against_loops(spark, seed, rounds):
    r = random.Random(seed)
    weights = {f"s{k}": 0.5 + 0.05 * k for k in range(8)}
    rows = [(f"g{k // 6}", f"r{k:04d}", s, r.choice([None, *range(40)]), r.choice([None, " ", *("abc" if r.random() < weights[s] else "defgh")]), None) for k in range(600) for s in [r.choice(sorted(weights))]]
    m = Fusion(rounds=rounds)
    want = brute(rows, m)
    got = {x["g"]: (x["name"], x["name_posterior"]) for x in fuse(frame(spark, rows), ["g"], "id", "src", "t", ["name"], model=m).collect() if x["name"] is not None}
    assert {g: v for g, (v, _) in got.items()} == {g: v for g, (v, _) in want.items()}
    assert all(abs(got[g][1] - want[g][1]) < 1e-9 for g in want)
