"""Tables that are written once and read again, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent_to: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Have Spark send this package to the executors, once for an application.

    Tasks import it, so that what they compile stays in their process from task to task.
    """
    context = spark.sparkContext
    if context.applicationId in _sent_to:
        return
    package = Path(__file__).resolve().parents[1]
    archive = f"{Path(tempfile.mkdtemp()).resolve()}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _sent_to.add(context.applicationId)


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one inside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: later plans know its size, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables made by ``keep`` that no later plan reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for frame in frames:
        folders = {name.rsplit("/", 1)[0] for name in frame.inputFiles()}
        for folder in folders:
            if "/llm-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
