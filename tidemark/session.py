"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Iterable
from functools import cache
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session for scripts and tests; on a cluster spark-submit supplies the master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # File sizes are compressed, so plan broadcasts only for clearly small files;
        # sizes measured at run time may be larger.
        .config("spark.sql.autoBroadcastJoinThreshold", "2m")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. On a local master, where one machine holds all executors, a folder
    in the warehouse serves if that is unset; elsewhere that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return f"{folder}/data"


_kept: dict[tuple, object] = {}
_locks: dict[tuple, threading.Lock] = {}


def once(spark: SparkSession, name: tuple, build: Callable[[], object]):
    """What ``build`` gave for ``name`` in this application, built when first asked for.

    For results that are costly, small to hold and written to the shared folder, such as fitted models. The
    name must tell the data apart (``stamp``).
    """
    key = (spark.sparkContext.applicationId, *name)
    with _locks.setdefault(key, threading.Lock()):
        if key not in _kept:
            _kept[key] = build()
        return _kept[key]


def stamp(spark: SparkSession, paths: Iterable[str]) -> tuple:
    """Size, number of files and time of change of each path: what changes when its data are replaced."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = store.getContentSummary(place)
        found.append((path, whole.getLength(), whole.getFileCount(), store.getFileStatus(place).getModificationTime()))
    return tuple(found)


@cache
def _source_digest() -> str:
    """Digest of the code that results are kept of, so that changed code makes them anew."""
    package = Path(__file__).parent
    texts = [f.read_bytes() for folder in ("functions", "operators", "sources") for f in sorted((package / folder).glob("*.py"))]
    return hashlib.sha256(b"\0".join(texts)).hexdigest()


class Kept:
    """Results that outlive the application, under a name in the shared folder that tells code and data apart.

    A result is written beside its place and renamed, so a killed attempt leaves nothing that counts, and of two
    attempts the first stays.
    """

    def __init__(self, spark: SparkSession, name: tuple):
        self.spark = spark
        label = hashlib.sha256(repr((_source_digest(), *name)).encode()).hexdigest()[:32]
        self.folder = f"{shared_dir(spark)}/tidemark/kept/{label}"

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, label: str, write: Callable[[str], None]) -> str:
        """Folder of a result, which ``write`` fills if there is none yet."""
        place, store = self._place(f"{self.folder}/{label}")
        if not store.exists(place):
            attempt, _ = self._place(f"{self.folder}/attempt-{label}-{uuid.uuid4().hex}")
            write(f"{attempt.toString()}/data")
            if not store.exists(place):
                store.rename(attempt, place)
        return f"{self.folder}/{label}/data"

    def table(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self.path(label, lambda path: build().write.parquet(path)))


def side_by_side(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """``work`` of every item, as independent jobs that share the cluster."""
    items = list(items)
    with ThreadPool(max(1, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts lineage, survives the loss of executors, and has a
    known size, so Spark broadcasts it in a later join only when it really is
    below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
