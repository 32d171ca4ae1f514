"""Result tables with a primary key: appended, replaced and purged by the partitions that change.

A table is laid out by site, if ``database_id`` is in its key, and by a bucket of the key.  Every
change is staged beside the table as the complete new content of the partitions it touches, checked,
and marked ready by one small file; then the staged partitions are moved into place one by one.  A
run that is lost before the mark has changed nothing.  One that is lost behind it is finished by
``settle_results``, with which every change and every read begins: partitions that have not been
moved yet are moved, those that have been stay.  Partitions no row goes to are never read or written.

A table has one writer at a time.  All columns of the specification are stored; optional ones that
new rows lack are NULL there, and those that older files lack are NULL when read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.network import (
    SITE_FILE,
    ColumnMismatch,
    FieldSpec,
    all_fields,
    check_columns,
    coerce_types,
    drop_duplicate_keys,
    fill_key_nulls,
    primary_key,
    spark_type,
    split_conflicts,
)
from .durable import children, exists, move, read_text, remove, write_text

SITE, BUCKET = "site_part", "key_bucket"
LAYOUT, READY = "_layout", "_ready"
#: Rows per bucket are what one task rewrites; state more buckets for larger tables.
BUCKETS = 32
SITE_COLUMN = "database_id"


class DuplicateKeys(ValueError):
    """Staged rows that share a key; nothing has been changed."""


def _parts(spec: Sequence[FieldSpec]) -> list[str]:
    return [SITE, BUCKET] if SITE_COLUMN in primary_key(spec) else [BUCKET]


def _folders(path: str, spec: Sequence[FieldSpec]) -> str:
    return "/".join([path, *("*=*" for _ in _parts(spec))])


def _schema(spec: Sequence[FieldSpec]) -> T.StructType:
    fields = ", ".join(f"`{f.name}` {spark_type(f)}" for f in spec)
    parts = ", ".join(f"{p} {'int' if p == BUCKET else 'string'}" for p in _parts(spec))
    return T.StructType.fromDDL(f"{fields}, {parts}")


def _site(column: Column) -> Column:
    """A folder name of letters and digits for any site, the empty one included."""
    return F.concat(F.lit("s"), F.lower(F.hex(F.encode(F.coalesce(column, F.lit("")), "utf-8"))))


def create_results(
    spark: SparkSession, path: str, spec: Sequence[FieldSpec], buckets: int = BUCKETS
) -> None:
    """An empty table, unless there is one."""
    if not primary_key(spec):
        raise ValueError("a keyed table needs a primary key")
    if read_text(spark, f"{path}/{LAYOUT}") is None:
        write_text(spark, f"{path}/{LAYOUT}", json.dumps({"buckets": buckets, "parts": _parts(spec)}))


def _layout(spark: SparkSession, path: str, spec: Sequence[FieldSpec]) -> int:
    text = read_text(spark, f"{path}/{LAYOUT}")
    if text is None:
        raise FileNotFoundError(f"{path} is no keyed result table")
    layout = json.loads(text)
    if layout["parts"] != _parts(spec):
        raise ColumnMismatch(f"{path} is laid out by {layout['parts']}, not {_parts(spec)}")
    return layout["buckets"]


def _stored(spark: SparkSession, path: str, spec: Sequence[FieldSpec]) -> DataFrame:
    """Rows with their partition columns; a stored column outside the specification is an error."""
    schema = _schema(spec)
    if not children(spark, _folders(path, spec)):
        return spark.createDataFrame([], schema)
    stored = spark.read.parquet(path).columns
    if unknown := sorted(set(stored) - set(schema.names)):
        raise ColumnMismatch(f"{path} holds columns outside the specification: {', '.join(unknown)}")
    return spark.read.schema(schema).parquet(path)


def read_results(spark: SparkSession, path: str, spec: Sequence[FieldSpec]) -> DataFrame:
    settle_results(spark, path)
    _layout(spark, path, spec)
    return _stored(spark, path, spec).select(*[f.name for f in spec])


def _prepared(new: DataFrame, spec: Sequence[FieldSpec], buckets: int) -> DataFrame:
    """New rows checked, coerced, one per key, with all columns and their place in the table."""
    key = primary_key(spec)
    rows = fill_key_nulls(coerce_types(check_columns(new, spec), spec), spec)
    order = [SITE_FILE] if SITE_FILE in new.columns else []
    rows = all_fields(drop_duplicate_keys(rows, key, order), spec)
    place = {BUCKET: F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")}
    if SITE in _parts(spec):
        place[SITE] = _site(F.col(SITE_COLUMN))
    return rows.withColumns(place).select(*_schema(spec).names)


def _publish(spark: SparkSession, path: str, stage: str) -> None:
    """Move what is staged; what the mark names and the stage lacks has been moved before."""
    mark = json.loads(read_text(spark, f"{stage}/{READY}"))
    for site in mark["purged"]:
        for there in children(spark, f"{path}/{SITE}={site}/{BUCKET}=*"):
            if "/".join(there.rsplit("/", 2)[1:]) not in mark["partitions"]:
                remove(spark, there)
    for part in mark["partitions"]:
        if exists(spark, f"{stage}/{part}"):
            remove(spark, f"{path}/{part}")
            move(spark, f"{stage}/{part}", f"{path}/{part}")
    remove(spark, stage)


def settle_results(spark: SparkSession, path: str) -> None:
    """Finish the changes that were marked ready; drop those that were not."""
    for stage in children(spark, f"{path}.stage-*"):
        if exists(spark, f"{stage}/{READY}"):
            _publish(spark, path, stage)
        else:
            remove(spark, stage)


def _stage(
    content: DataFrame, path: str, spec: Sequence[FieldSpec], purged: Sequence[str] = ()
) -> None:
    """Write, check and publish the new content of the partitions in ``content``."""
    spark, parts = content.sparkSession, _parts(spec)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    # One task writes a partition, so a bucket is a file and a bucket of one site never many.
    content.repartition(*parts).write.partitionBy(*parts).parquet(stage)
    found = ["/".join(p.rsplit("/", len(parts))[1:]) for p in children(spark, _folders(stage, spec))]
    if found:
        written = spark.read.schema(_schema(spec)).parquet(stage)
        twice = written.groupBy(*primary_key(spec)).count().where("count > 1").limit(1).count()
        if twice:
            remove(spark, stage)
            raise DuplicateKeys(f"rows for {path} share keys; the table is as it was")
    write_text(spark, f"{stage}/{READY}", json.dumps({"partitions": found, "purged": list(purged)}))
    _publish(spark, path, stage)


def append_keyed(
    new: DataFrame, path: str, spec: Sequence[FieldSpec], overwrite: bool | None = None
) -> None:
    """Add rows; for keys that both sides have see ``split_conflicts``.

    Only partitions that get a row are read and written, old columns and all.
    """
    spark, key = new.sparkSession, primary_key(spec)
    settle_results(spark, path)
    rows = _prepared(new, spec, _layout(spark, path, spec))
    existing = _stored(spark, path, spec)
    parts = _parts(spec)
    near = existing.join(rows.select(*parts).distinct(), parts, "left_semi")
    kept, added = split_conflicts(near, rows, key, overwrite)
    if kept is near:  # old rows stay, so partitions in which nothing is new stay too
        kept = near.join(added.select(*parts).distinct(), parts, "left_semi")
    _stage(kept.unionByName(added), path, spec)


def replace_sites(
    new: DataFrame, path: str, spec: Sequence[FieldSpec], sites: Sequence[str] | None = None
) -> None:
    """Remove all rows of ``sites`` (else of the sites in ``new``) and add ``new``.

    Running it again leaves the same table.
    """
    spark = new.sparkSession
    if SITE not in _parts(spec):
        raise ValueError(f"{SITE_COLUMN} is not in the key, so no site can be purged")
    settle_results(spark, path)
    rows = _prepared(new, spec, _layout(spark, path, spec))
    _stored(spark, path, spec)
    purged = rows.select(SITE).distinct()
    if sites is not None:
        stated = [f"s{s.encode().hex()}" for s in sites]
        strange = purged.where(~F.col(SITE).isin(stated)).limit(1).count()
        if strange:
            raise ValueError("new rows belong to sites that are not purged")
    else:
        stated = [r[0] for r in purged.collect()]
    _stage(rows, path, spec, sorted(stated))
