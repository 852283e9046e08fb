import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankledger import runtime
from rankledger.functions import canon, text
from rankledger.operators import checks, choices, identity, store

PEOPLE = "person string, source_person_key string, provider string, name string, school string, event string, entry string"


def resolved(spark, people, links):
    members, codes = identity.resolve(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(links, "left_key string, right_key string"))
    groups = defaultdict(set)
    for r in members.distinct().collect():
        groups[r["competitor"]].add(r["person"])
    return {frozenset(g) for g in groups.values()}, sorted({(r["code"], r["subject"]) for r in codes.collect()})


LONG = "a" * 49 + "b"


def test_resolution_by_stages(spark):
    people = [
        ("1", "x:1", "x", "Ann Lee", "S", "e1", "n1"), ("2", "x:1", "x", "Ann Lee", "S", "e2", "n1"),  # one stable key
        ("3", "y:7", "y", "A. Lee", "T", "e3", "n1"),  # joined by a link
        ("4", None, "x", "Ann Lee", "S", "e4", "n9"), ("5", None, "x", "Ann Lee", "T", "e5", "n9"),  # exact evidence joins 4; 5 is of another school
        ("6", "x:2", "x", "Bo Roe", "S", "e1", "n2"), ("7", "x:3", "x", "Cy Doe", "S", "e1", "n3"),  # a link of two keys of one provider is refused
        ("8", None, "x", "Di Poe", "S", "e1", "n4"), ("9", None, "x", "Di Poe", "S", "e1", "n5"),  # equal evidence, two entries in one event
        ("10", None, "x", LONG, "S", "e1", "n6"), ("11", None, "x", LONG[:-1] + "c", "S", "e2", "n6"),  # alike, and each other's only match
        ("12", None, "x", LONG, "U", "e1", "n7"), ("13", None, "x", LONG[:-1] + "c", "U", "e1", "n8"),  # alike, but in one event
        ("14", "x:9", "x", "Ed Foe", "S", "e1", "n10"), ("15", "x:9", "x", "Ed Fox", "S", "e2", "n10"),
    ]
    links = [("x:1", "y:7"), ("x:2", "x:3"), ("x:1", "x:1"), ("x:1", "gone"), ("x:2", "y:7"), ("y:7", "x:2")]
    groups, codes = resolved(spark, people, links)
    assert groups == {frozenset(g) for g in ({"1", "2", "3", "4"}, {"5"}, {"6"}, {"7"}, {"8"}, {"9"}, {"10", "11"}, {"12"}, {"13"}, {"14", "15"})}
    assert codes == sorted([("AMBIGUOUS", LONG), ("AMBIGUOUS", LONG[:-1] + "c"), ("AMBIGUOUS", "Ann Lee"), ("EDGE_CONFLICT", "k:x:2"), ("EDGE_DANGLING", "x:1|gone"), ("EDGE_DUPLICATE", "x:2|y:7"), ("EDGE_DUPLICATE", "y:7|x:2"), ("EDGE_SELF", "x:1|x:1"), ("STABLE_ID_CONFLICT", "x:9")])


def test_resolution_does_not_depend_on_the_order(spark):
    r = random.Random(6)
    people = [(str(i), r.choice([None, *(f"p{k % 3}:{k}" for k in range(12))]), None, r.choice("abcdef"), r.choice("st"), f"e{r.randrange(40)}", f"n{i}") for i in range(60)]
    people = [(p, k, k.split(":")[0] if k else "none", *rest) for p, k, _, *rest in people]
    links = [(f"p{a % 3}:{a}", f"p{b % 3}:{b}") for a, b in itertools.combinations(range(12), 2) if (a * b) % 7 == 3]
    first = resolved(spark, people, links)
    r.shuffle(people)
    assert resolved(spark, people, links[::-1]) == first and sum(map(len, first[0])) == 60
    assert resolved(spark, [], []) == (set(), [])


def test_hash_in_chunks_and_numbers(spark):
    rows = [(i // 3 if i % 10 else None, i, "x" * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, _j string")
    digest = lambda d, n: canon.chunked_hash(d, ["a", "_j"], ["a", "b"], n).first()[0]
    assert digest(df, 7) == digest(df.repartition(9).orderBy(F.rand(3)), 7) != digest(df.where("b <> 5"), 7)
    got = sorted((r["n"], r["b"]) for r in canon.numbered(df, ["a", "b"], "n").collect())
    assert [b for _, b in got] == [b for _, b in sorted(((a is not None, a or 0), b) for a, b, _ in rows)] and [n for n, _ in got] == list(range(1, 201))
    assert canon.numbered(df.where("false"), ["a"]).collect() == []
    sums = {r["b"]: r["s"] for r in canon.running_total(df.withColumn("_amount", F.lit("x")), ["b"], F.when(F.col("b") % 3 > 0, F.col("b")), "s").collect()}
    assert sums == {i: sum(k for k in range(i + 1) if k % 3) for i in range(200)}


def test_guarded_update_and_migration(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int"), spark.createDataFrame([(1, 9), (2, 1), (3, 7)], "k int, v int")
    updated, missed = store.guarded_update(old, new, ["k"], F.col("new.v") > F.col("old.v"))
    assert sorted(map(tuple, updated.collect())) == [(1, 9), (2, 5)] and sorted(r["k"] for r in missed.collect()) == [2, 3]
    facts, target = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (2, "b", 3)], "k int, n string, t int"), spark.createDataFrame([(1, "a", 3), (2, "b", 3), (9, "z", 1)], "k int, n string, t int")
    none, some = spark.range(0), spark.range(1)
    moved, n = store.migrate(facts, target, "k", ["n"], ["t"], none)
    assert n == 2 and sorted(map(tuple, moved.collect())) == [(1, "a", 3), (1, "a", 3), (2, "b", 3)]
    assert store.migrate(moved, target, "k", ["n"], ["t"], some)[1] == 0
    for f, b in ((facts, some), (facts.unionAll(spark.createDataFrame([(5, "e", 1)], facts.schema)), none), (facts.withColumn("n", F.upper("n")), none)):
        with pytest.raises(store.MigrationRefused):
            store.migrate(f, target, "k", ["n"], ["t"], b)


def test_outbox_and_leases(spark):
    box = spark.createDataFrame([("a", "sent"), ("b", "pending")], "job_id string, state string")
    jobs = spark.createDataFrame([("a",), ("c",), ("c",), ("d",)], "job_id string")
    sent = spark.createDataFrame([("b", True), ("c", False), ("a", False), ("d", False), ("d", True)], "job_id string, ok boolean")
    assert {r["job_id"]: r["state"] for r in store.claim_outbox(box, jobs, sent).collect()} == {"a": "sent", "b": "sent", "c": "pending", "d": "sent"}
    leases = spark.createDataFrame([("l", "a", 1), ("m", "a", 1)], "name string, owner string, at int")
    assert [r["name"] for r in store.release_leases(leases, spark.createDataFrame([("l", "b"), ("m", "a")], "name string, owner string")).collect()] == ["l"]


def test_evidence_and_names_with_places(spark):
    rows = [("1st Ann, 2nd Bo", ["Ann", "Bo"], True), ("1 Ann 12 Bo", ["Ann", "Bo"], False), ("2. Bo 1. Ann", ["Ann", "Bo"], False), ("Ann Bo", ["Ann", "Bo"], False), ("1 Ann", [], True), (None, ["A"], False), ("1: Ann 2 a very long way to Bo", ["Ann", "Bo"], False), ("11st Ann", ["Ann"], False)]
    df = spark.createDataFrame(rows, "t string, n array<string>, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", text.placements_named(F.col("t"), F.col("n")).alias("got")).collect())
    sheet = spark.createDataFrame([("The Open 2025: 1 Ａnn",), ("the open 2024: 1 Ann",), ("2025 1 Ann",), ("Open the open 2025: Ann",), (None,)], "t string")
    assert [r["error"] for r in text.with_evidence_error(sheet, "t", ["The Open"], F.lit("2025"), F.array(F.lit("Ann"))).collect()] == [None, "WRONG_SEASON", "WRONG_TOURNAMENT", "PLACEMENTS_MISMATCH", "WRONG_TOURNAMENT"]


def test_small_text_rules(spark):
    one = lambda values, f: [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(f(F.col("c"))).collect()]
    assert one(["B. IX varsity (online)", "JV IX", "ix", "novices ix", None, ""], lambda c: text.listed_event(c, ["ix", "novices ix"])) == [True, False, True, True, False, False]
    assert one(["none 12", "none 12b", "none ", "None 1", None, "none 1\n"], lambda c: text.placeholder_school(c, "none")) == [True, False, False, False, False, False]
    blobs = spark.createDataFrame([(b"ok",), (b"\xef\xbb\xbfx",), (b"\xff",), (b"",), (None,)], "b binary")
    assert [r[0] for r in blobs.select(text.utf8_error(F.col("b"))).collect()] == [None, "BOM", "NOT_UTF8", None, None]


def test_packets_and_digests(spark):
    d = spark.createDataFrame([("2024-01-01T00:00:00Z", "body")], "at string, body string").withColumn("sig", canon.hmac_sha256(b"k")(canon.packet_text(F.col("at"), F.col("body"))))
    error = lambda body, now, key=b"k": d.select(canon.packet_error(F.col("at"), F.lit(body), F.col("sig"), F.to_timestamp(F.lit(now)), key)).first()[0]
    assert error("body", "2024-01-01 00:05:00") is None and error("body", "2024-01-01 00:05:01") == "EXPIRED" and error("bodY", "2024-01-01 00:00:00") == "BAD_SIGNATURE" and error("body", "2024-01-01 00:00:00", b"j") == "BAD_SIGNATURE"
    have = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    want = have.where("k < 3").select("k", F.sha2(F.when(F.col("k") == 1, F.col("t")).otherwise("z"), 256).alias("sha256"), F.lit(1).cast("bigint").alias("bytes"))
    assert {r["k"]: r["error"] for r in checks.digest_errors(have, want, "k", "t").collect()} == {1: None, 2: "DIGEST_MISMATCH", 3: "NOT_REVIEWED"}


def test_broadcasts_are_sized_by_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    rows = spark.range(50).withColumn("v", F.lit("x" * 100))
    assert hinted(runtime.small(rows)) and not hinted(runtime.small(rows, limit=49)) and not hinted(runtime.small(rows, most_bytes=4000)) and hinted(runtime.small(rows.where("false")))


def test_unique_choices_against_all_combinations(spark):
    r = random.Random(9)
    rows = []
    for k in range(120):
        slots = [[[int(r.random() < 0.4), int(r.random() < 0.6)] for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(0, 5))]
        rows.append((k, slots, [r.randrange(3), r.randrange(4)]))
    rows += [(500, None, [0, 0]), (501, [], [0, 0]), (502, [[]], [0, 0]), (503, [], None), (504, [[[1, 0]] for _ in range(40)], [40, 0]), (505, [[[1, 0], [0, 0]] for _ in range(40)], [20, 0])]
    df = spark.createDataFrame(rows, "k int, slots array<array<array<int>>>, totals array<int>")
    got = {x["k"]: (x["chosen"], x["code"]) for x in choices.unique_choices(df, "k", "slots", "totals").collect()}
    for k, slots, totals in rows[:120]:
        ways = {tuple(c) for c in itertools.product(*[[next(j for j, y in enumerate(s) if y == x) for x in s] for s in slots]) if [sum(s[i][a] for s, i in zip(slots, c)) for a in (0, 1)] == totals}
        assert got[k] == ((list(next(iter(ways))), None) if len(ways) == 1 else (None, "AMBIGUOUS" if ways else "NO_COMBINATION")), k
    assert [got[k][1] for k in range(500, 506)] == ["NO_COMBINATION", None, "NO_COMBINATION", "NO_COMBINATION", None, "AMBIGUOUS"] and got[501][0] == [] and got[504][0] == [0] * 40
