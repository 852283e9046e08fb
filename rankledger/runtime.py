"""Session helpers shared by every operator: table reads, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH_ROOT = "rankledger-scratch"
_ROOTS: dict[str, str] = {}
_LIVE: dict[str, SparkSession] = {}

#: A side is broadcast only when it has at most so many rows and, by the widths of its first rows, at most so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is used. Only where the setting is
    absent (tests, local mode) is a folder of our own made.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/{_SCRATCH_ROOT}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _ROOTS:
        _ROOTS[app] = tempfile.mkdtemp(prefix=f"{_SCRATCH_ROOT}-")
        atexit.register(_remove_local, _ROOTS[app])
    return f"file://{_ROOTS[app]}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Stored:
    """A DataFrame written to the scratch folder: its lineage is the files, so a lost executor costs nothing."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        """Delete the files; only when no plan that is still to run reads them."""
        _delete(self.df.sparkSession, self.path)
        _LIVE.pop(self.path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def store(df: DataFrame, label: str) -> Stored:
    """Write ``df`` as parquet to the scratch folder and read it back (zstd, so disk stays below the input)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    if not _LIVE:
        atexit.register(_sweep)
    _LIVE[path] = spark
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def _sweep() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; a cluster's own retention removes the folder
            pass
    _LIVE.clear()


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast if it is small by rows and bytes, else leave the join to AQE's shuffle plan.

    Sizes at most ``limit + 1`` rows, in one job; meant for stored tables and dimensions. Bytes are those of the rows as
    JSON, which is more than they take in memory.
    """
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most_bytes else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
