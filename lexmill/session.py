"""Sessions, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lexmill", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lexmill-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder that the session names in spark.checkpoint.dir.

    The folder is set here only where the session names none, as in local tests; a cluster must name a folder that all
    executors share, so that the cut survives the loss of an executor.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: its source goes to every executor through Spark's file server, once for
    a context, unless the workers' path already holds it."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or getattr(sc, "_lexmill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="lexmill-package-"))
    archive = folder / "lexmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "lexmill").rglob("*.py")):
            out.write(source, source.relative_to(root))
    sc.addPyFile(str(archive))
    sc._lexmill_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, under the application's id."""
    return f"{_checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read back: a lineage cut that is compressed and
    columnar, so that later stages read only the columns they need. The folder lives as long as the checkpoints do."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_files(table: DataFrame) -> list[str]:
    """The files of a written table, in the order in which they were written."""
    return sorted(table.inputFiles())


def stored_batches(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Within a task: batches of about so many rows of a written table, read from the shared folder page by page, so that
    many tasks can go through a large table that no shuffle copies and no task holds."""
    for uri in files:
        scheme, _, path = uri.partition(":")
        local = scheme == "file"
        system, path = (LocalFileSystem(), unquote("/" + path.lstrip("/"))) if local else FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))
        with system.open_input_file(path) as file:
            yield from pq.ParquetFile(file, buffer_size=2**20, pre_buffer=False).iter_batches(rows, columns=columns, use_threads=False)


def values(column: pa.Array) -> list:
    """What to_pylist gives, several times faster where nothing is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, spread over all of them: for small files with much work in each
    row. A scan of enough partitions stays as it is, so nothing is shuffled at scale."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; no result that reads it may be in use any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_checkpoint_folder(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _WRITTEN.clear()


#: tables written once for an application, by application, source and name
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, source: str, name: str, write: Callable[[str], None]) -> str:
    """The path of what write leaves there, which happens once for an application and source."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _WRITTEN:
        path = shared_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
