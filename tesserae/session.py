"""Session helpers: sessions for local runs, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesserae")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors in which intermediate tables are written.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder is made and set, but only for a local master: on a cluster a
    machine-local folder would be lost with its machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tesserae-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_WRITTEN: list[Scratch] = []


@atexit.register
def _clean() -> None:
    """What this process wrote to the shared folder goes when it ends."""
    for scratch in list(_WRITTEN):
        try:
            scratch.drop(scratch.root)
        except Exception:  # noqa: BLE001 - the session may be gone; then the folder's owner cleans up
            return


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, for sessions that run long: frames made inside can't be read after it."""
    before = list(_WRITTEN)
    try:
        yield
    finally:
        for scratch in [s for s in _WRITTEN if s not in before]:
            scratch.drop(scratch.root)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``save`` writes and reads back, so that a lost executor costs no recomputation
    of what came before; ``drop`` deletes tables that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _WRITTEN.append(self)

    def save(self, df: DataFrame, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
        self._n += 1
        path = f"{self.root}/{self._n:05d}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        return self.read(path, df.schema), path

    def read(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, path: str) -> None:
        """Deletes a table, or with ``root`` all of them, now and not when the process ends."""
        if path == self.root and self in _WRITTEN:
            _WRITTEN.remove(self)
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
