"""Versioned parquet tables: append-only versions, a marker written last, idempotent publishing, merges without MERGE."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishConflict(RuntimeError):
    """A version id is published again with other content."""


class VersionStore:
    """Versions below ``root``: tables in <root>/data/<version>-<attempt>/, listed by markers <root>/_versions/<version>.json.

    Every attempt to publish writes its own folder; the marker, which names it, is created last and never overwritten, so
    of two publishers of one version one wins, and readers see whole versions only.
    """

    MARKERS = "_versions"
    SCHEMA = "version string, season string, content_hash string, created_at timestamp, path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _create(self, path: str, text: str) -> bool:
        """Writes a new file; False if it is there already."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def versions(self) -> DataFrame:
        """version, season, content_hash, created_at and path of every published version."""
        fs, p = self._fs(f"{self.root}/{self.MARKERS}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(f"{self.root}/{self.MARKERS}")

    def publish(self, version: str, season: str, content_hash: str, created_at: str, tables: dict[str, DataFrame]) -> bool:
        """False if the version is already there with the same content; PublishConflict if with another."""
        if self._known(version, content_hash):
            return False
        path = f"{self.root}/data/{version}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")
        marker = {"version": version, "season": season, "content_hash": content_hash, "created_at": created_at, "path": path}
        if self._create(f"{self.root}/{self.MARKERS}/{version}.json", json.dumps(marker)):
            return True
        fs, p = self._fs(path)
        fs.delete(p, True)
        if not self._known(version, content_hash):
            raise PublishConflict(version)
        return False

    def _known(self, version: str, content_hash: str) -> bool:
        same = self.versions().where(F.col("version") == version).select("content_hash").first()
        if same is not None and same[0] != content_hash:
            raise PublishConflict(version)
        return same is not None

    def table(self, version: str, name: str) -> DataFrame:
        row = self.versions().where(F.col("version") == version).select("path").first()
        if row is None:
            raise KeyError(version)
        return self.spark.read.parquet(f"{row[0]}/{name}")

    def history(self, season: str) -> DataFrame:
        return self.versions().where(F.col("season") == season).orderBy(F.desc("created_at"), F.desc("version"))

    def current(self, season: str) -> str | None:
        """The newest version; of equal times the greater id."""
        row = self.history(season).select("version").first()
        return row and row[0]

    def unchanged(self, season: str, content_hash: str) -> bool:
        """Whether the current version has this content, so that a caller can skip its work."""
        row = self.history(season).select("content_hash").first()
        return row is not None and row[0] == content_hash


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one a key (the smallest row)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return one.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def conflicting(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have with different content: an identical insert is no conflict."""
    rest = [c for c in new.columns if c not in keys]
    other = existing.select(*keys, F.struct(*rest).alias("_old"))
    return new.join(other, keys).where(~F.struct(*rest).eqNullSafe(F.col("_old"))).select(*keys).distinct()


def merge(existing: DataFrame, new: DataFrame, keys: list[str], replace: Column) -> DataFrame:
    """Upsert: a new key is inserted, a known one replaced where ``replace`` holds (columns old.x and new.x)."""
    rest = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*rest).alias("old"))
    b = new.select(*keys, F.struct(*rest).alias("new"))
    both = a.join(b, keys, "full_outer")
    take = F.col("old").isNull() | (F.col("new").isNotNull() & F.coalesce(replace, F.lit(False)))
    return both.select(*keys, F.when(take, F.col("new")).otherwise(F.col("old")).alias("_r")).select(*keys, "_r.*").select(*existing.columns)


def guarded_update(existing: DataFrame, new: DataFrame, keys: list[str], guard: Column) -> tuple[DataFrame, DataFrame]:
    """(existing with the rows of ``new`` in place where ``guard`` (on old.x and new.x) holds, keys of new rows that changed nothing).

    A caller that needs every row updated treats a non-empty second table as a failed update.
    """
    rest = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*rest).alias("old"))
    b = new.select(*keys, F.struct(*rest).alias("new"))
    both = a.join(b, keys, "full_outer").withColumn("_ok", F.col("old").isNotNull() & F.col("new").isNotNull() & F.coalesce(guard, F.lit(False)))
    updated = both.where("old IS NOT NULL").select(*keys, F.when(F.col("_ok"), F.col("new")).otherwise(F.col("old")).alias("_r")).select(*keys, "_r.*").select(*existing.columns)
    return updated, both.where("new IS NOT NULL AND NOT _ok").select(*keys)


class MigrationRefused(RuntimeError):
    """Facts that a migration would change are in use, or are not what it expects."""


def migrate(facts: DataFrame, target: DataFrame, key: str, fixed: list[str], fields: list[str], blockers: DataFrame) -> tuple[DataFrame, int]:
    """(facts with ``fields`` as in ``target``, rows changed), all or nothing.

    A fact without a target, or one whose ``fixed`` columns differ from it, refuses the migration; so does any blocker
    row, if there is something to change. Counted are offenders, blockers and changes: three numbers.
    """
    own = target.select(F.col(key), F.struct(*fixed, *fields).alias("_want"))
    met = facts.join(own, key, "left")
    same = lambda columns: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_want.{c}")) for c in columns], F.lit(True))
    wrong = F.col("_want").isNull() | ~same(fixed)
    offenders, changes = met.agg(F.count_if(wrong), F.count_if(~wrong & ~same(fields))).first()
    if offenders:
        raise MigrationRefused(f"{offenders} facts are not those the migration expects")
    if changes and not blockers.isEmpty():
        raise MigrationRefused("facts that depend on the old values exist")
    moved = met.select(*[F.col(f"_want.{c}").alias(c) if c in fields else F.col(c) for c in facts.columns])
    return (moved if changes else facts), changes


def claim_outbox(outbox: DataFrame, jobs: DataFrame, sent: DataFrame) -> DataFrame:
    """outbox: job_id, state (pending or sent). New jobs come in as pending, once each; a pending one whose sending succeeded is marked sent.

    sent: job_id, ok of this round's attempts; a failed attempt leaves its job pending, and nothing that is sent is sent again.
    """
    known = outbox.select("job_id", "state").unionByName(insert_ignore(outbox, jobs.select("job_id").distinct().withColumn("state", F.lit("pending")), ["job_id"]))
    done = sent.groupBy("job_id").agg(F.bool_or("ok").alias("_ok"))
    return known.join(done, "job_id", "left").select("job_id", F.when(F.col("_ok"), F.lit("sent")).otherwise(F.col("state")).alias("state"))


def release_leases(leases: DataFrame, releases: DataFrame) -> DataFrame:
    """Leases without those that their own owner gives back (name, owner)."""
    return leases.join(releases.select("name", "owner").distinct(), ["name", "owner"], "left_anti").select(*leases.columns)


def take_leases(leases: DataFrame, claims: DataFrame, seconds: int = 900) -> DataFrame:
    """leases and claims: name, owner, at (timestamp; of a lease: its expiry). A claim wins a free or expired lease, or its own.

    At the very instant of expiry the owner still holds it.
    """
    wanted = claims.groupBy("name").agg(F.min_by(F.struct("owner", "at"), F.struct("at", "owner")).alias("c")).select("name", "c.owner", "c.at")
    free = (F.col("old.at") < F.col("new.at")) | (F.col("old.owner") == F.col("new.owner"))
    old = leases.select("name", "owner", "at")
    a, b = old.select("name", F.struct("owner", "at").alias("old")), wanted.select("name", F.struct("owner", "at").alias("new"))
    both = a.join(b, "name", "full_outer")
    take = F.col("old").isNull() | (F.col("new").isNotNull() & free)
    until = F.col("new.at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return both.select("name", F.when(take, F.col("new.owner")).otherwise(F.col("old.owner")).alias("owner"), F.when(take, until).otherwise(F.col("old.at")).alias("at"))


def put_blobs(manifest: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new blobs by digest, collisions): content goes to <first two digits>/<digest>, once; a size that differs is an error."""
    hashed = blobs.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"), "media_type", "content")
    one = hashed.dropDuplicates(["sha256"]).withColumn("key", F.concat(F.lit("snapshots/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256"))
    known = manifest.select("sha256", F.col("bytes").alias("_bytes"), F.col("media_type").alias("_media"))
    clash = one.join(known, "sha256").where("bytes <> _bytes OR NOT media_type <=> _media").select("sha256")
    return one.join(known, "sha256", "left_anti"), clash
