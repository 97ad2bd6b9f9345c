"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# AQE picks the join strategy from measured sizes, so no join in this package
# carries a broadcast hint.  forceOptimizeSkewedJoin lets it split a hot join key
# even where the split costs one more exchange before the next aggregate.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package relies on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


# A task of a join or aggregate holds its partition as rows, 15 to 20 times the shuffled bytes;
# one that deals rows out to many partitions holds those of its part of a file.
PARTITION_MB, SPLIT_MB = 16, 32
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT = "spark.sql.files.maxPartitionBytes"
_coarse: WeakKeyDictionary[SparkSession, dict[str, str | None]] = WeakKeyDictionary()


def fine_shuffles(spark: SparkSession, *paths: str) -> None:
    """Shuffles in as many parts as the files at ``paths`` call for, put together to ``PARTITION_MB`` by AQE.

    The session's number of partitions is fixed, so that a task's share would grow with the
    tables.  The files' bytes are about half of those shuffled.
    """
    _coarse.setdefault(spark, {name: spark.conf.get(name, None) for name in (INITIAL, ADVISED, SPLIT)})
    size = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 2 // (PARTITION_MB << 20)))
    spark.conf.set(INITIAL, str(parts))
    spark.conf.set(ADVISED, f"{PARTITION_MB}m")
    spark.conf.set(SPLIT, f"{SPLIT_MB}m")


def coarse_shuffles(spark: SparkSession) -> None:
    """The settings before ``fine_shuffles``."""
    for name, value in _coarse.pop(spark, {}).items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so the workers must
    be able to import the package wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="salesmix-src-"), "salesmix_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("salesmix", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("salesmix")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder, reachable from every executor, for tables written mid-way.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local
    session may fall back to the machine's own temporary folder.
    """
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir")
            or spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="salesmix-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _scopes:
        folders.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """The working folders made while this is open, for ``remove`` when nothing reads them any more."""
    folders: list[str] = []
    _scopes.append(folders)
    try:
        yield folders
    finally:
        _scopes.remove(folders)


def remove(spark: SparkSession, folders: list[str], but_for: DataFrame | None = None) -> list[str]:
    """Delete working folders, but those that the plan of ``but_for`` reads, which are returned."""
    read = but_for.inputFiles() if but_for is not None else []
    kept = []
    for folder in folders:
        if any(f"{folder.split(':')[-1].lstrip('/')}/" in f for f in read):
            kept.append(folder)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame], **options: int | str) -> DataFrame:
    """The result of ``build``, stored; tables that it stored on the way are removed.

    The frames of the way are dropped too, so that the engine may delete their shuffle files.
    """
    with scope() as folders:
        out = stored(build(), name, **options)
    remove(spark, [f for f in folders if f != out._salesmix_path])
    gc.collect()
    spark._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that no later job reads."""
    path = getattr(df, "_salesmix_path", None)
    if path:
        remove(df.sparkSession, [path])


def stored(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write a table, with these options of the writer, that several branches of a plan read, and read it back.

    The branches then share one computation, and joins see its real size.
    """
    path = work_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._salesmix_path = path
    return out
