"""Session settings and the shared folder of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the cluster's ``spark.checkpoint.dir``, or in tests one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._paperloom_shipped = True


_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Deletes the intermediate tables this process has written; results that read them must be stored before."""
    gone = 0
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def written(df: DataFrame, name: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again.

    Cuts the lineage: what follows reads the files, so a lost executor costs its tasks and no earlier stage.
    With ``by`` the rows lie in one folder for each value of that column, and a filter on it reads these folders only.
    The tables stay until ``drop_written``, which passes over those to ``keep``, or the cluster clears the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    if not keep:
        _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> bool:
    """Whether the files of a written table are still there; its first and its last one are looked for."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return bool(paths) and all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths[:1] + paths[-1:])


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a stored table: changes when its files do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(at)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(at).getModificationTime()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a data folder.

    A table of one or two files, which a scan could only read in as many tasks, is spread over the cores; filters
    and column pruning go below the exchange.  Tables of more files are read as they are.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in SPREAD and df.rdd.getNumPartitions() * 4 <= spark.sparkContext.defaultParallelism:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


#: Tables with long texts, whose work per row is worth an exchange of a small table.
SPREAD = ("pages", "chunk", "documents")
