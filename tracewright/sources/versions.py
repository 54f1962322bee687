"""Tables with versions: Parquet folders that never change, and a log of which of them make up each version.

A writer puts its rows into a folder of their own, then creates the log's next entry, which only one writer can. Who
loses reads the version that won and tries again, so two writers lose nothing; a stop before the entry leaves a folder that no
version names. Readers take the last entry, so they see whole versions alone.

Defined results: an absent table has version 0 and no rows; null keys are keys; repeated rows stay in `append`; in `upsert` the
last by `order` stays for each key; in `bump` null counts are 0."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.sources.files import file_system

LOG, TRIES = "_versions", 20


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the table's versions, rising."""
    fs, log, _ = file_system(spark, f"{path}/{LOG}")
    if not fs.exists(log):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(log) if f.getPath().getName().endswith(".json"))


def entry(spark: SparkSession, path: str, version: int) -> dict:
    """What a version is made of: schema, folders, operation."""
    fs, at, _ = file_system(spark, f"{path}/{LOG}/{version:020d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame | None]:
    """(version, rows) of the last whole version, or of the one named; (0, null) without any."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return 0, None
    found = entry(spark, path, version)
    schema = StructType.fromJson(found["schema"])
    return version, spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in found["folders"]))


def created(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Creates a version's entry, whole and at once; false if it is there already."""
    fs, temporary, make = file_system(spark, f"{path}/{LOG}/.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    try:
        stream.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        stream.close()
    target = make(f"{path}/{LOG}/{version:020d}.json")
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # a local rename replaces what is there; a link doesn't
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(temporary, target, none)
        return True
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(temporary, False)


def folder(rows: DataFrame, path: str) -> str:
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    return name


def commit(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], operation: str, expected: int | None = None, tries: int = TRIES) -> int:
    """Makes a version of change(rows of the last one), computed again whenever another writer was first. With
    `expected`, raises Conflict unless the table is at just that version. Gives the new version."""
    for _ in range(tries):
        version, rows = read(spark, path)
        if expected is not None and version != expected:
            raise Conflict(f"{path} is at version {version}, not {expected}")
        new = change(rows)
        name = folder(new, path)
        if created(spark, path, version + 1, {"schema": new.schema.jsonValue(), "folders": [name], "operation": operation}):
            return version + 1
        drop(spark, path, [name])
    raise Conflict(f"{path}: {tries} tries, and each time another writer was first")


def append(rows: DataFrame, path: str, tries: int = TRIES) -> int:
    """Adds rows as a folder beside the others, which is written once, however often the log's entry is tried. Columns are
    those of the table, by name."""
    spark = rows.sparkSession
    name = None
    for _ in range(tries):
        version, old = read(spark, path)
        found = entry(spark, path, version) if version else {"schema": rows.schema.jsonValue(), "folders": []}
        if name is None:
            same = rows if old is None else rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in old.schema))
            name = folder(same, path)
        if created(spark, path, version + 1, found | {"folders": [*found["folders"], name], "operation": "append"}):
            return version + 1
    drop(spark, path, [name])
    raise Conflict(f"{path}: {tries} tries, and each time another writer was first")


def upsert(new: DataFrame, path: str, keys: list[str], order: str, expected: int | None = None) -> int:
    """The last row by `order` for each key, of the table's and the new ones."""
    from tracewright.operators.relational import upsert as last

    return commit(new.sparkSession, path, lambda old: last(new.limit(0) if old is None else old, new, keys, F.col(order)), "upsert", expected)


def bump(counts: DataFrame, path: str, keys: list[str], column: str) -> int:
    """Adds counts(keys, column) to the table's, key by key."""

    def change(old: DataFrame | None) -> DataFrame:
        both = counts.select(*keys, F.col(column).cast("long"))
        both = both if old is None else old.select(*keys, column).unionByName(both)
        return both.groupBy(*keys).agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(column))

    return commit(counts.sparkSession, path, change, "bump")


def drop(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        fs, at, _ = file_system(spark, f"{path}/{name}")
        fs.delete(at, True)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes folders that none of the last `keep` versions names, and the entries of older versions. To be run
    while nobody writes: a writer's folder has no version yet. Gives the folders."""
    last = versions(spark, path)
    used = {f for v in last[-keep:] for f in entry(spark, path, v)["folders"]}
    fs, place, _ = file_system(spark, path)
    gone = [n for n in sorted(f.getPath().getName() for f in fs.listStatus(place)) if n.startswith("data-") and n not in used]
    drop(spark, path, [f"{LOG}/{v:020d}.json" for v in last[:-keep]])
    drop(spark, path, gone)
    return gone
