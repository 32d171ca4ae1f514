"""Results that are found again: stored under a fingerprint of what they are made from.

The fingerprint covers the input files (path, size, time of change), the definition, and the source
of this package, so a result is never taken for that of other data, settings or code.  A result
appears under its name when it is complete; two sessions that build it at once leave one.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from .durable import children, exists, file_system, hadoop_path, move, remove, work_dir

PREFIX = "spanrate-kept-"


@cache
def _code() -> str:
    package = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for folder in ("functions", "operators", "plans", "sources", "."):
        for source in sorted((package / folder).glob("*.py")):
            digest.update(source.read_bytes())
    return digest.hexdigest()


def file_states(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every file, by one listing per folder."""
    states = {}
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):  # encoded, as inputFiles() gives them
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for status in file_system(spark, target).listStatus(target):
            name = status.getPath().getName()
            states[folder, name] = status.getLen(), status.getModificationTime()
    parts = [(f, *f.rsplit("/", 1)) for f in sorted(files)]
    return [(f, *states[folder, unquote(name)]) for f, folder, name in parts]


def fingerprint(inputs: Sequence[DataFrame], definition: object) -> str:
    """Of everything that decides a result; ``definition`` is anything JSON or ``repr`` tells apart."""
    spark = inputs[0].sparkSession
    files = sorted({f for df in inputs for f in df.inputFiles()})
    made_from = [file_states(spark, files), json.dumps(definition, default=repr, sort_keys=True), _code()]
    return hashlib.sha256(json.dumps(made_from).encode()).hexdigest()


def reused(
    name: str, inputs: Sequence[DataFrame], definition: object, build: Callable[[], DataFrame]
) -> DataFrame:
    """The result that ``build`` gives, stored at first and read from then on.

    ``inputs`` are the frames, straight from files, that ``build`` reads.
    """
    spark = inputs[0].sparkSession
    path = f"{work_dir(spark)}/{PREFIX}{name}-{fingerprint(inputs, definition)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        fresh = f"{path}.new-{uuid.uuid4().hex}"
        build().write.parquet(fresh)
        if exists(spark, f"{path}/_SUCCESS"):  # another session was faster
            remove(spark, fresh)
        else:
            move(spark, fresh, path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, older_than_days: float = 0) -> list[str]:
    """Remove stored results, unfinished ones too, that were made so long ago; returns their paths."""
    limit = (time.time() - older_than_days * 86_400) * 1000
    gone = []
    for path in children(spark, f"{work_dir(spark)}/{PREFIX}*"):
        target = hadoop_path(spark, path)
        if file_system(spark, target).getFileStatus(target).getModificationTime() <= limit:
            remove(spark, path)
            gone.append(path)
    return gone
