import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankledger.operators import arbitration, checks, identity, scoring, standings, store, views
from rankledger.runtime import store as stored


def test_scoring_table(spark):
    rows = [(2, 1, "final", 150, "placement"), (3, 6, "final", 33, "placement"), (2, None, "final", 38, "semifinal-bucket"), (4, 7, "final", 18, "semifinal-bucket"), (5, None, "semifinal", 0, "no-eligible-bucket"), (2, None, "octafinal", 8, "octafinal-bucket"), (None, 1, "final", None, None), (2, 0, "final", None, None), (2, 3, "semifinal", None, None), (2, None, None, 0, "no-eligible-bucket")]
    df = spark.createDataFrame(rows, "tier int, placement int, furthest_stage string, want int, rule string").withColumns({"top_six_only": F.lit(False), "final_credit_limit": F.lit(6)})
    for r in scoring.score(df).collect():
        assert (r["points"], r["scoring_rule"]) == (r["want"], r["rule"]), r
    shut = spark.createDataFrame([(2, 7, "final"), (2, None, "semifinal"), (2, 6, "final")], "tier int, placement int, furthest_stage string").withColumns({"top_six_only": F.lit(True), "final_credit_limit": F.lit(5)})
    assert [(r["points"], r["final_credit"]) for r in scoring.score(shut).collect()] == [(0, False), (0, False), (50, False)]


def test_national(spark):
    rows = [(1, "final", "ix", "ix", True, 300, "nsda-strong-field-final-round-winner"), (2, "final", "ix", "usx", False, 170, "nsda-base"), (6, "final", "ix", "ix", False, 83, "nsda-strong-field"), (None, "final", "ix", None, False, 0, "nsda-base"), (None, "octafinal", "ix", "ix", False, 13, "nsda-strong-field"), (15, "quarterfinal", "ix", None, False, 30, "nsda-base")]
    df = spark.createDataFrame(rows, "placement int, furthest_stage string, division string, bonus_division string, won_final_round boolean, want int, rule string")
    for r in scoring.score_national(df).collect():
        assert (r["points"], r["scoring_rule"]) == (r["want"], r["rule"]), r
    bad = spark.createDataFrame([(7, "final", "ix", None, True), (1, "semifinal", "ix", None, False)], "placement int, furthest_stage string, division string, bonus_division string, won_final_round boolean")
    assert [r["error_code"] for r in scoring.score_national(bad).collect()] == ["CONTRADICTORY_FINAL_ROUND", "CONTRADICTORY_STAGE"]


def test_max_and_ranks_do_not_depend_on_order(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice("xyz"), r.choice([10, 20]), r.choice([None, 1, 2]), r.choice(["ix", "usx"]), k, True, True, False) for k in range(60)]
    schema = "e string, p string, points int, placement int, division string, k int, win boolean, top_three boolean, final_credit boolean"
    want = {}
    for x in rows:
        key = (-x[2], x[3] if x[3] is not None else 2**31, x[4], x[5])
        want[x[0], x[1]] = min(want.get((x[0], x[1]), key), key)
    for seed in (1, 2):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 60), schema).repartition(5)
        best = standings.max_per_edition(df, ["e"], "p", ["k"])
        assert {(x["e"], x["p"]): x["k"] for x in best.collect()} == {k: v[3] for k, v in want.items()}
    total = spark.createDataFrame([("s", "a", 5, 1, 0, 0), ("s", "b", 5, 1, 0, 0), ("s", "c", 9, 0, 0, 0), ("s", "d", 1, 0, 0, 0)], "s string, p string, points long, wins long, top_threes long, finals long")
    assert {x["p"]: x["standing_rank"] for x in standings.competition_rank(total, ["s"]).collect()} == {"c": 1, "a": 2, "b": 2, "d": 4}


def test_components_and_contradictions(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            for x in (a, b):
                parent.setdefault(x, x)
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["id"]: x["component"] for x in identity.connected(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert identity.connected(spark.createDataFrame([], "a int, b int")).collect() == []
    members = spark.createDataFrame([("c1", "n", "s", "e1", "x"), ("c2", "n", "s", "e1", "y"), ("c3", "m", "s", "e1", "x"), ("c4", "m", "s", "e2", "x")], "c string, name string, school string, event string, entry string")
    assert {x["c"]: x["merged"] for x in identity.merge_exact(members, "c", ["name", "school"], "event", "entry").collect()} == {"c1": "c1", "c2": "c2", "c3": "c3", "c4": "c3"}


def test_similar_pairs_against_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdef") for _ in range(n)) for n in (49, 50, 60, 99, 101, 150)]
    names = set(base)
    for b in base:
        for _ in range(8):
            s = list(b)
            for _ in range(r.choice([1, 1, 2, 3])):
                k = r.randrange(len(s))
                s[k:k + 1] = r.choice([[], [r.choice("xyz")], [s[k], "q"]])
            names.add("".join(s))
    names = sorted(names)
    df = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "id int, block int, name string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if i % 2 == j % 2 and abs(len(names[i]) - len(names[j])) < 5 and 50 * edits(names[i], names[j]) <= max(len(names[i]), len(names[j]))}
    got = {(x["left"], x["right"]) for x in identity.similar_pairs(df, "block", "name", "id").collect()}
    assert got == want and len(want) > 5


def test_similar_across_broadcasts_nothing_that_was_exploded(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in range(49, 200)]
    twins = [n[:20] + "z" + n[20:] for n in names]
    people = stored(spark.createDataFrame([(n, s, s + n) for s, side in (("s", names), ("t", twins)) for n in side], "name string, school string, id string"), "across").df
    found = identity.similar_across(people, "school", "name", "id")
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()  # Spark's guess of sizes says that all of them are small
    assert {(x["name"], x["other"], x["scopes"]) for x in found.collect()} == {(*sorted(p), 2) for p in zip(names, twins)}


def test_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("c", "e")], "x string, y string")
    assert [(r["x"], r["y"]) for r in identity.mutual_unique(e, "x", "y").collect()] == [("a", "b")]
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "z"), ("b", "c")], "left_key string, right_key string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {(r["left_key"], r["right_key"], r["code"]) for r in identity.explicit_edge_errors(edges, known, "key").collect()} == {("a", "a", "SELF"), ("a", "b", "DUPLICATE"), ("b", "a", "DUPLICATE"), ("a", "z", "DANGLING")}


def test_arbitration(spark):
    rows = [("g1", "s1", True, True, False, 4, 10, 1), ("g1", "s2", True, True, False, 4, 10, 1), ("g1", "s3", True, False, True, 4, 20, 2), ("g1", "s4", True, True, False, 3, 30, 3), ("g1", "s5", True, False, False, 4, 40, 4), ("g1", "s6", False, True, False, 4, 50, 5),
            ("g2", "s7", True, True, False, 1, 1, 1), ("g2", "s8", True, True, False, 1, 1, 2)]
    df = spark.createDataFrame(rows, "g string, snapshot_id string, valid boolean, explicit_final boolean, correction boolean, prec int, instant int, content int")
    got = {r["snapshot_id"]: (r["reason"], r["selected_snapshot_id"]) for r in arbitration.arbitrate(df, ["g"]).collect()}
    assert got == {"s1": (None, "s1"), "s2": ("DUPLICATE_CONTENT", "s1"), "s3": ("SUPERSEDED", "s1"), "s4": ("LOWER_PRECEDENCE", "s1"), "s5": ("NONFINAL", "s1"), "s6": ("INVALID", "s1"), "s7": ("CONFLICT_WITHHELD", None), "s8": ("CONFLICT_WITHHELD", None)}


def test_checks(spark):
    left = spark.createDataFrame([("a",), (None,), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("c", 3), ("c", 4)], "r string, v int")
    assert {(r["k"], r["v"], r["matches"]) for r in checks.exactly_one(left, right, [("k", "r")], "v").collect()} == {("a", 1, 1), (None, 2, 1), ("c", None, 2)}
    good, bad = checks.validate(spark.createDataFrame([(1, "x"), (None, "x"), (2, "")], "a int, b string"), [("A", F.col("a") > 0), ("B", F.col("b") != "")])
    assert good.count() == 1 and sorted(r["error_code"] for r in bad.collect()) == ["A", "B"]
    diff = checks.full_diff(spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "k int, v string"), ["k"], ["v"])
    assert {(r["k"], r["status"], tuple(r["fields"] or ())) for r in diff.collect()} == {(1, "missing", ()), (2, "differs", ("v",)), (4, "extra", ())}
    child = spark.createDataFrame([("p1",), ("p9",), (None,)], "p string")
    assert [r["p"] for r in checks.missing_parents(child, ["p"], spark.createDataFrame([("p1",)], "id string"), ["id"]).collect()] == ["p9"]


def test_store(spark, tmp_path):
    s = store.VersionStore(spark, f"file://{tmp_path}/v")
    assert s.current("2020-21") is None
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    assert s.publish("v1", "2020-21", "h1", "2021-01-01 00:00:00", {"standings": rows})
    assert not s.publish("v1", "2020-21", "h1", "2021-01-01 00:00:00", {"standings": rows})
    with pytest.raises(store.PublishConflict):
        s.publish("v1", "2020-21", "h2", "2021-01-01 00:00:00", {"standings": rows})
    s.publish("v2", "2020-21", "h2", "2021-02-01 00:00:00", {"standings": rows})
    assert s.current("2020-21") == "v2" and s.unchanged("2020-21", "h2") and [r["version"] for r in s.history("2020-21").collect()] == ["v2", "v1"]
    rows.write.parquet(f"{tmp_path}/v/v3/standings")  # written but never marked
    with pytest.raises(KeyError):
        s.table("v3", "standings")


def test_merge_leases_blobs(spark):
    old = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int")
    new = spark.createDataFrame([(2, 9), (2, 9), (3, 1)], "k int, v int").distinct()
    assert {tuple(r) for r in store.merge(old, new, ["k"], F.col("new.v") > F.col("old.v")).collect()} == {(1, 5), (2, 9), (3, 1)}
    assert {tuple(r) for r in store.insert_ignore(old, new, ["k"]).collect()} == {(3, 1)}
    assert [r["k"] for r in store.conflicting(old, new, ["k"]).collect()] == [2]
    ts = "name string, owner string, at timestamp"
    leases = spark.sql("SELECT * FROM VALUES ('a', 'x', timestamp'2024-01-01 10:00:00'), ('b', 'x', timestamp'2024-01-01 10:00:00'), ('c', 'x', timestamp'2024-01-01 10:00:00') t(name, owner, at)")
    claims = spark.sql("SELECT * FROM VALUES ('a', 'y', timestamp'2024-01-01 10:00:00'), ('b', 'y', timestamp'2024-01-01 10:00:01'), ('c', 'x', timestamp'2024-01-01 09:00:00'), ('d', 'z', timestamp'2024-01-01 09:00:00') t(name, owner, at)")
    assert ts and {(r["name"], r["owner"], str(r["at"])) for r in store.take_leases(leases, claims).collect()} == {("a", "x", "2024-01-01 10:00:00"), ("b", "y", "2024-01-01 10:15:01"), ("c", "x", "2024-01-01 09:15:00"), ("d", "z", "2024-01-01 09:15:00")}
    blobs = spark.createDataFrame([(bytearray(b"x"), "t"), (bytearray(b"x"), "t"), (bytearray(b"y"), "t")], "content binary, media_type string")
    manifest = blobs.where("content = X'78'").limit(1).select(F.sha2("content", 256).alias("sha256"), F.lit(9).cast("bigint").alias("bytes"), "media_type")
    fresh, clash = store.put_blobs(manifest, blobs)
    assert fresh.count() == 1 and clash.count() == 1


def test_views(spark):
    df = spark.createDataFrame([("s", 2, 'x"y'), ("s", 1, None), ("t", 1, "a,b")], "g string, k int, n string")
    got = {r["g"]: r["csv"] for r in views.csv_lines(df, ["k", "n"], ["g"], ["k"], "k,n").collect()}
    assert got == {"s": 'k,n\r\n1,\r\n2,"x""y"\r\n', "t": 'k,n\r\n1,"a,b"\r\n'}
    rows = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", None), ("q", "z"), ("q", "z"), ("q", "y")], "p string, s string")
    assert {(r["p"], r["s"]) for r in views.modal_school(rows, "p", "s").collect()} == {("p", "a"), ("q", "z")}


def test_version_groups_are_whole(spark):
    rows = [("s", f"p{i}", i % 4, 0, 0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, p string, points long, wins long, top_threes long, finals long")
    counts = defaultdict(int)
    for r in standings.competition_rank(df, ["s"]).collect():
        counts[r["standing_rank"]] += 1
    assert counts == {1: 10, 11: 10, 21: 10, 31: 10}
