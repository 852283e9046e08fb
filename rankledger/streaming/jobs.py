"""Streams at the job boundary: de-duplicated enqueueing, retries with back-off, stability timers, late evidence.

Every stream runs to its end under availableNow with a checkpoint in the scratch folder, writes parquet, and has a batch
equivalent with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import time
from ..runtime import scratch_root

BACKOFF = (900, 3600, 21600)
MAX_ATTEMPTS = 4


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table's parquet files as a stream; event-time operators need timestamps with a zone, so those are cast."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream until its input is used up and returns what it wrote."""
    spark = stream.sparkSession
    at = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream until its input is used up, one function call a micro-batch."""
    at = f"{scratch_root(stream.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    stream.writeStream.foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def job_rows(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """Jobs with deterministic ids: SHA-256 of type, key and the day's bucket."""
    bucket = time.daily_bucket(F.col(at))
    body = F.to_json(F.array(F.lit(kind), F.col(key).cast("string"), F.date_format(bucket, "yyyy-MM-dd HH:mm:ss")))
    return events.select(F.sha2(body, 256).alias("job_id"), F.col(key).alias("job_key"), bucket.alias("scheduled_for"), F.col(at).alias("at"))


def new_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence (edition_id, sha256, id) whose content an edition has not brought before: the first to arrive stands, all others end here.

    Digests stay in the state, so a repeat is met however late it comes.
    """
    return evidence.dropDuplicates(["edition_id", "sha256"])


def dedup_jobs(jobs: DataFrame) -> DataFrame:
    """Each job once, however late its rows come: without a watermark all job ids stay in the state."""
    return jobs.dropDuplicates(["job_id"]).select("job_id", "job_key", "scheduled_for")


RETRY_OUT = "job_id string, attempts int, state string, wait_seconds int"


def retry_states(outcomes: DataFrame) -> DataFrame:
    """job_id, seq, ok: the state machine of a job's attempts, kept per job across micro-batches.

    A success ends the job; a failure waits 900, 3600, then 21600 s; the fourth failure is a dead letter. Outcomes that
    come after the end change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, ended = state.get if state.exists else (0, False)
        out = []
        for ok in pd.concat(list(batches)).sort_values("seq")["ok"]:
            if ended:
                break
            attempts += 1
            if ok:
                ended, word, wait = True, "succeeded", None
            elif attempts >= MAX_ATTEMPTS:
                ended, word, wait = True, "dead_lettered", None
            else:
                word, wait = "retrying", BACKOFF[min(attempts, len(BACKOFF)) - 1]
            out.append((key[0], attempts, word, wait))
        state.update((attempts, ended))
        frame = pd.DataFrame(out, columns=["job_id", "attempts", "state", "wait_seconds"])
        yield frame.astype({"attempts": "int32", "wait_seconds": "Int32"})

    return outcomes.groupBy("job_id").applyInPandasWithState(step, RETRY_OUT, "attempts int, ended boolean", "append", GroupStateTimeout.NoTimeout)


STATES_OUT = "job_id string, seq long, state string, attempts int, wait_seconds int"
# State and event, and the state that follows; a failure leads on by the number of attempts.
TRANSITIONS = {
    ("", "enqueued"): "queued", ("queued", "started"): "running", ("retrying", "started"): "running",
    ("running", "succeeded"): "succeeded", ("running", "refused"): "failed", ("running", "failed"): "retrying",
}


def job_states(events: DataFrame) -> DataFrame:
    """job_id, seq, event: every change of state of every job, kept per job across micro-batches.

    A start counts an attempt; a failure waits as ``retry_states`` does, or is the dead letter after the last attempt; a
    refused job has failed for good. Events that do not fit the state, such as a second start of a running job, change
    nothing. Events of one micro-batch are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts = state.get if state.exists else ("", 0)
        out = []
        for seq, event in pd.concat(list(batches)).sort_values("seq", kind="stable")[["seq", "event"]].itertuples(index=False):
            after = TRANSITIONS.get((now, event))
            if after is None:
                continue
            attempts += after == "running"
            wait = None
            if after == "retrying":
                if attempts >= MAX_ATTEMPTS:
                    after = "dead_lettered"
                else:
                    wait = BACKOFF[min(attempts, len(BACKOFF)) - 1]
            now = after
            out.append((key[0], seq, now, attempts, wait))
        state.update((now, attempts))
        frame = pd.DataFrame(out, columns=["job_id", "seq", "state", "attempts", "wait_seconds"])
        yield frame.astype({"seq": "int64", "attempts": "int32", "wait_seconds": "Int32"})

    return events.groupBy("job_id").applyInPandasWithState(step, STATES_OUT, "state string, attempts int", "append", GroupStateTimeout.NoTimeout)


STABLE_DAYS = 7


def _stable_at(end, latest):
    """The later of a span's end and its latest evidence, and the quiet days."""
    return F.greatest(end, latest) + F.make_dt_interval(F.lit(STABLE_DAYS))


def stability(events: DataFrame, ends: DataFrame, key: str, at: str, end: str, as_of: str) -> DataFrame:
    """Per key of ``ends``: evidence, and whether end and latest evidence lie the quiet days before as_of; new evidence re-arms the timer.

    A key without an end is never stable; one without evidence counts from its end.
    """
    latest = events.groupBy(key).agg(F.count(F.lit(1)).alias("evidence"), F.max(at).alias("_last"))
    met = ends.join(latest, key, "left")
    stable = F.col(end).isNotNull() & (_stable_at(F.col(end), F.col("_last")) <= F.lit(as_of).cast("timestamp_ntz"))
    return met.select(key, F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce(stable, F.lit(False)).alias("stable"))


def scheduled_jobs(editions: DataFrame, as_of: str) -> DataFrame:
    """(id, kind, reason, scheduled_for) that a daily run enqueues for editions: id, start_at, end_at, latest (timestamps), final_season.

    Nothing before the start is known and the end has passed. Results are collected once; stability is verified daily
    until it is reached, weekly from then on, and weekly for corrections once the season is final.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    waiting = ~F.col("final_season") & (now < _stable_at(F.col("end_at"), F.col("latest")))
    collect = F.struct(F.lit("collect-results").alias("kind"), F.lit("RESULTS_ENDED").alias("reason"), F.col("end_at").alias("scheduled_for"))
    verify = F.struct(F.lit("verify-stability").alias("kind"), F.when(F.col("final_season"), "FINAL_SEASON_WEEKLY_CORRECTION").when(waiting, "STABILITY_DAILY").otherwise("STABILITY_WEEKLY").alias("reason"),
                      F.when(waiting, time.daily_bucket(now)).otherwise(time.weekly_bucket(now)).cast("timestamp_ntz").alias("scheduled_for"))
    due = editions.where(F.col("start_at").isNotNull() & F.col("end_at").isNotNull() & (F.col("end_at") <= now))
    return due.select("id", F.explode(F.array_compact(F.array(F.when(~F.col("final_season"), collect), verify))).alias("j")).select("id", "j.*")


def ready_seasons(editions: DataFrame, as_of: str, lineage: str) -> DataFrame:
    """(season_id, stable_at) of seasons that may become final: the closing ``lineage``'s edition is final or corrected, and stable by as_of.

    editions: season_id, lineage_id, status, end_at, latest, final_season; a season that is final already is left out.
    """
    closing = editions.where((F.col("lineage_id") == lineage) & F.col("status").isin("final", "corrected") & ~F.col("final_season"))
    return closing.select("season_id", _stable_at(F.col("end_at"), F.col("latest")).alias("stable_at")).where(F.col("stable_at") <= F.lit(as_of).cast("timestamp_ntz")).groupBy("season_id").agg(F.min("stable_at").alias("stable_at"))


def dead_letters(states: DataFrame) -> DataFrame:
    """(job_id, attempts, code) of jobs that ended without success: rows for the dead-letter table."""
    return states.where("state = 'dead_lettered'").select("job_id", "attempts", F.lit("ATTEMPTS_EXHAUSTED").alias("code"))


def quiet_sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of events without a pause of ``gap``: the closed ones are what the timer would have fired on."""
    w = F.session_window(F.col(at), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("from"), F.col("w.end").alias("until"), "events")


def versions_of_late_evidence(events: DataFrame, key: str, at: str, final_at: str) -> DataFrame:
    """provisional before the first final instant of a key, final at it, corrected after: late rows are never dropped."""
    first = events.groupBy(key).agg(F.min(F.when(F.col(final_at), F.col(at))).alias("_f"))
    joined = events.join(first, key)
    status = F.when(F.col("_f").isNull() | (F.col(at) < F.col("_f")), "provisional").when(F.col(at) == F.col("_f"), "final").otherwise("corrected")
    return joined.withColumn("status", status).drop("_f")
