from datetime import datetime

from pyspark.sql import functions as F

from rankledger.streaming import jobs

D = datetime


def frame(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    return jobs.read_stream(spark, str(tmp_path), "in", files_per_trigger=1)


def test_dedup_over_batches(spark, tmp_path):
    day = lambda d, h: D(2024, 1, d, h)
    stream = frame(spark, tmp_path, [[(1, day(1, 3)), (1, day(1, 9))], [(1, day(1, 20)), (2, day(1, 1)), (1, day(2, 1))]], "k int, ts timestamp_ntz")
    got = jobs.run_to_end(jobs.dedup_jobs(jobs.job_rows(stream, "k", "ts", "collect"))).collect()
    assert sorted((r["job_key"], str(r["scheduled_for"])) for r in got) == [(1, "2024-01-01 08:17:00"), (1, "2024-01-02 08:17:00"), (2, "2024-01-01 08:17:00")]


def test_dedup_keeps_late_jobs_and_knows_old_ones(spark, tmp_path):
    parts = [[(1, D(2024, 1, d, 3)), (2, D(2024, 1, d, 3))] for d in (20, 12, 5, 1, 20, 1)]
    got = jobs.run_to_end(jobs.dedup_jobs(jobs.job_rows(frame(spark, tmp_path, parts, "k int, ts timestamp_ntz"), "k", "ts", "collect"))).collect()
    assert sorted((r["job_key"], r["scheduled_for"].day) for r in got) == [(k, d) for k in (1, 2) for d in (1, 5, 12, 20)]


def test_retry_states_keep_across_batches(spark, tmp_path):
    rows = [[("a", 1, False), ("b", 1, True), ("c", 1, False)], [("a", 2, False), ("a", 3, False), ("b", 2, False)], [("a", 4, False), ("a", 5, True), ("c", 2, True)]]
    stream = frame(spark, tmp_path, rows, "job_id string, seq long, ok boolean")
    got = sorted(tuple(r) for r in jobs.run_to_end(jobs.retry_states(stream)).collect())
    by_job = lambda j: [g[1:] for g in got if g[0] == j]
    assert [x[1] for x in by_job("a")] == ["retrying", "retrying", "retrying", "dead_lettered"] and [x[2] for x in by_job("a")] == [900, 3600, 21600, None]
    assert by_job("b") == [(1, "succeeded", None)] and [x[1] for x in by_job("c")] == ["retrying", "succeeded"]


def test_stability_rearms_and_late_evidence(spark):
    e = spark.createDataFrame([(1, D(2024, 1, 1)), (1, D(2024, 1, 5)), (2, D(2024, 1, 1)), (9, D(2024, 1, 1))], "k int, ts timestamp_ntz")
    ends = spark.createDataFrame([(1, D(2023, 12, 1)), (2, D(2023, 12, 1)), (3, D(2024, 1, 1)), (4, D(2024, 1, 2)), (5, None)], "k int, fin timestamp_ntz")
    assert {r["k"]: (r["evidence"], r["stable"]) for r in jobs.stability(e, ends, "k", "ts", "fin", "2024-01-08 00:00:00").collect()} == {1: (2, False), 2: (1, True), 3: (0, True), 4: (0, False), 5: (0, False)}
    v = spark.createDataFrame([("e", 1, False), ("e", 2, True), ("e", 3, False), ("f", 1, False)], "k string, t int, final boolean")
    assert sorted((r["k"], r["t"], r["status"]) for r in jobs.versions_of_late_evidence(v, "k", "t", "final").collect()) == [("e", 1, "provisional"), ("e", 2, "final"), ("e", 3, "corrected"), ("f", 1, "provisional")]


def test_foreach_batch_sees_all_rows(spark, tmp_path):
    stream = frame(spark, tmp_path, [[(1, "a")], [(2, "b"), (3, "c")]], "k int, v string")
    seen = []
    jobs.run_batches(stream, lambda df, n: seen.append(df.agg(F.sum("k")).first()[0]))
    assert sum(x for x in seen if x) == 6


def test_scheduled_jobs_and_ready_seasons(spark):
    rows = [("a", D(2024, 1, 1), D(2024, 1, 2), None, False), ("b", D(2024, 1, 1), D(2024, 1, 9), D(2024, 1, 9), False), ("c", D(2024, 1, 1), D(2024, 1, 2), None, True), ("d", None, D(2024, 1, 2), None, False), ("e", D(2024, 1, 1), D(2024, 2, 2), None, False), ("f", D(2024, 1, 1), None, None, False)]
    df = spark.createDataFrame(rows, "id string, start_at timestamp_ntz, end_at timestamp_ntz, latest timestamp_ntz, final_season boolean")
    got = {(r["id"], r["reason"]): str(r["scheduled_for"]) for r in jobs.scheduled_jobs(df, "2024-01-10 12:00:00").collect()}
    assert got == {("a", "RESULTS_ENDED"): "2024-01-02 00:00:00", ("a", "STABILITY_WEEKLY"): "2024-01-08 08:17:00", ("b", "RESULTS_ENDED"): "2024-01-09 00:00:00", ("b", "STABILITY_DAILY"): "2024-01-10 08:17:00", ("c", "FINAL_SEASON_WEEKLY_CORRECTION"): "2024-01-08 08:17:00"}
    seasons = df.withColumns({"season_id": F.col("id"), "lineage_id": F.lit("last"), "status": F.when(F.col("id") == "b", "provisional").otherwise("final")})
    assert [r["season_id"] for r in jobs.ready_seasons(seasons, "2024-01-10 12:00:00", "last").collect()] in (["a", "d"], ["d", "a"])


def test_new_evidence_and_dead_letters(spark, tmp_path):
    stream = frame(spark, tmp_path, [[("e", "x", "1")], [("e", "x", "2"), ("e", "y", "3"), ("f", "x", "4")], [("e", "y", "5")]], "edition_id string, sha256 string, id string")
    got = sorted((r["edition_id"], r["sha256"]) for r in jobs.run_to_end(jobs.new_evidence(stream)).collect())
    assert got == [("e", "x"), ("e", "y"), ("f", "x")]
    states = spark.createDataFrame([("a", 4, "dead_lettered"), ("b", 1, "succeeded")], "job_id string, attempts int, state string")
    assert [tuple(r) for r in jobs.dead_letters(states).collect()] == [("a", 4, "ATTEMPTS_EXHAUSTED")]


def test_job_states_across_batches(spark, tmp_path):
    words = [["enqueued"], ["started", "started", "failed"], ["succeeded", "started"], ["refused", "started"]]
    parts, seq = [], 0
    for batch in words:
        parts.append([("a", (seq := seq + 1), w) for w in batch])
    parts[1] += [("b", k, w) for k, w in enumerate(["succeeded", "enqueued", *(["started", "failed"] * 5)], 100)]
    got = sorted(tuple(r) for r in jobs.run_to_end(jobs.job_states(frame(spark, tmp_path, parts, "job_id string, seq long, event string"))).collect())
    assert [r[1:] for r in got if r[0] == "a"] == [(1, "queued", 0, None), (2, "running", 1, None), (4, "retrying", 1, 900), (6, "running", 2, None), (7, "failed", 2, None)]
    assert [r[2] for r in got if r[0] == "b"] == ["queued", *(["running", "retrying"] * 3), "running", "dead_lettered"]
