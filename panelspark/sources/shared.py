"""Tables between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application
    (as ``--py-files`` does): tasks with Python code import it by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent.parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a local master
    gets a folder of its own; on a cluster that is an error, as executors would
    write to their own disks."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, kind: str = "panelspark") -> str:
    """A name in the shared folder that is not taken. Who sets the folder clears
    it: nothing here is read after the query that wrote it."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that made them has ended; otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Queries built and run inside leave no shuffle files; ``settings`` of ``spark.sql.execution.arrow`` hold there, too."""
    wanted = {_CLEANUP: "true"} | {f"spark.sql.execution.arrow.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: it is computed once, and
    a lost executor costs no more than a read of its files. The disk holds the
    shuffles of one such table at a time."""
    spark = df.sparkSession
    path = new_path(spark)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`saved` that nothing reads any more."""
    spark = df.sparkSession
    context = spark.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("panelspark-"):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
