import os

import pytest
from pyspark.sql import functions as F

from rankledger.operators.store import VersionStore
from rankledger.plans import rebuild, registry
from rankledger.streaming import jobs

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@needs_data
def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


@needs_data
def test_rebuild_is_permutation_invariant_and_published_once(spark, tmp_path, monkeypatch):
    season = rebuild.rebuild(spark, SF)["standings"].groupBy("season_id").count().orderBy(F.desc("count"), "season_id").first()[0]
    store = VersionStore(spark, f"file://{tmp_path}/v")
    version, new = rebuild.publish_season(spark, SF, season, store, "2024-01-01 00:00:00")
    assert new and store.current(season) == version
    plain = rebuild.distinct
    monkeypatch.setattr(rebuild, "distinct", lambda *a: plain(*a).repartition(7).sortWithinPartitions(F.rand(3)))
    assert rebuild.publish_season(spark, SF, season, store, "2024-01-02 00:00:00") == (version, False)
    top = store.table(version, "leaders")
    assert 0 < top.count() <= 25 and store.table(version, "standings").count() >= top.count()


@needs_data
def test_stream_equals_batch(spark):
    stream = jobs.run_to_end(jobs.dedup_jobs(jobs.job_rows(jobs.read_stream(spark, SF, "events"), "user_id", "ts", "collect"))).select("job_id")
    batch = jobs.job_rows(spark.read.parquet(f"{SF}/events.parquet"), "user_id", "ts", "collect").select("job_id").distinct()
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()
