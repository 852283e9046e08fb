from datetime import datetime

from rankledger.operators.matching import match_lineages
from rankledger.sources import archives, calendar

D = datetime
CANDIDATE = "candidate_id string, title string, start_at timestamp_ntz, end_at timestamp_ntz, organizer string, event_labels array<string>, platform_key string, past_key string, middle_school_only boolean, independent_overlap boolean"
FINGERPRINT = "lineage_id string, names array<string>, organizers array<string>, labels array<string>, platform_keys array<string>, past_keys array<string>, start_month int, end_month int"


def candidate(i, title="Winter Open", org="Host U", labels=("IX",), platform=None, past=None, start=D(2025, 1, 10), end=D(2025, 1, 12), ms=False, overlap=False):
    return (i, title, start, end, org, list(labels), platform, past, ms, overlap)


def run(spark, candidates):
    f = spark.createDataFrame([("w", ["Winter Open", "The Winter-Open!"], ["host u"], ["ix", "usx"], ["k1"], ["p1"], 12, 2)], FINGERPRINT)
    matches, rejected = match_lineages(spark.createDataFrame(candidates, CANDIDATE), f)
    return [tuple(r) for r in matches.collect()], {(r["candidate_id"], r["reason"]) for r in rejected.collect()}


def test_precedence_and_ambiguity(spark):
    assert run(spark, [candidate("a"), candidate("b", title="x", platform="K1 ")]) == ([("w", "b", "verified-platform-key", False)], set())
    assert run(spark, [candidate("a"), candidate("b", title="the winter open")]) == ([("w", None, "exact-facts", True)], set())
    assert run(spark, [candidate("a", org=None)]) == ([], set())


def test_rejections_in_order(spark):
    got = run(spark, [
        candidate("org", org="Other", ms=True), candidate("over", overlap=True, ms=True), candidate("ms", ms=True), candidate("bad", end=D(2025, 1, 1)), candidate("out", start=D(2025, 5, 1), end=D(2025, 5, 2)), candidate("event", labels=["debate"]), candidate("ok", past="P1", org=None)])
    assert got == ([("w", "ok", "official-past-edition", False)], {("org", "ORGANIZER_CONTRADICTION"), ("over", "INDEPENDENT_OVERLAP"), ("ms", "MIDDLE_SCHOOL_ONLY"), ("bad", "MALFORMED_CANDIDATE"), ("out", "OUTSIDE_LINEAGE_WINDOW"), ("event", "NO_ELIGIBLE_EVENT")})


def test_details_and_packets(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><x data-org='A &amp; B'>"), (2, "<h1>T</h1><x data-org='a' data-org='b'>"), (3, "<x>")], "p int, html string")
    assert [(r["title"], r["data_org"], r["error"]) for r in calendar.details(pages, "p", "html", ["data-org"]).orderBy("id").collect()] == [("T", "A & B", None), ("T", None, "DUPLICATE_ATTRIBUTE"), (None, None, "MISSING_TITLE")]
    rows = [("ok", f"n{i}", i) for i in range(1, 7)] + [("few", "n", 1)] + [("twice", "N " if i == 2 else "n" if i == 1 else f"n{i}", i) for i in range(1, 7)]
    assert {tuple(r) for r in archives.reviewed_errors(spark.createDataFrame(rows, "k string, name string, place int"), "k", "name", "place").collect()} == {("few", "PLACES_INCOMPLETE"), ("twice", "NAME_REPEATED")}
