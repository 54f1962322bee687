"""Files: logs, sources, manifests, archives, objects, tables, and what writes them."""

from __future__ import annotations

import gzip
import io
import posixpath
import subprocess
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ship

#: Limits of an archive: bytes unpacked, entries, ratio of unpacked to packed (fixed values).
MOST_BYTES, MOST_ENTRIES, MOST_RATIO = 10 << 30, 50_000, 100


def scratch(spark: SparkSession) -> str:
    """The shared folder for what a query writes on its way; a temporary one only where none is named and
    all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="tracewright-")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what a loop does between its rounds, so that
    plans stay short and lost executors cost one round. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place, _ = file_system(spark, path)
    fs.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line_no, line) of every *.log below the folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def java_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of every *.java below the folder but tests."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java")
    return rows.select(F.col("_metadata.file_path").alias("path"), "value").where(~F.col("path").contains("/src/test/"))


def objects(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, content): list and get in one; unread contents aren't loaded."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def json_objects(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).json(folder)


def json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def entries(name: str, raw: bytes, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES, most_ratio: int = MOST_RATIO) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a zip, tar(.gz), gz or plain file; raises on what leaves the folder or is a bomb."""
    total = count = 0

    def checked(path: str, content: bytes) -> tuple[str, bytes]:
        nonlocal total, count
        clean = posixpath.normpath(path.replace("\\", "/"))
        if clean.startswith(("/", "..")) or ":" in clean.split("/")[0]:
            raise PermissionError(f"entry leaves the archive: {path}")
        total, count = total + len(content), count + 1
        if total > most_bytes or count > most_entries or total // max(1, len(raw)) > most_ratio:
            raise ValueError(f"archive exceeds its limits: {name}")
        return clean, content

    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if sum(i.file_size for i in z.infolist()) // max(1, len(raw)) > most_ratio:
                raise ValueError(f"archive exceeds its limits: {name}")
            for info in z.infolist():
                if not info.is_dir():
                    yield checked(info.filename, z.read(info))
    elif low.endswith((".tar.gz", ".tgz", ".tar")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for member in t:
                if member.isfile():
                    yield checked(member.name, t.extractfile(member).read())
    elif low.endswith(".gz"):
        with gzip.open(io.BytesIO(raw)) as g:
            yield checked(posixpath.basename(name)[:-3], g.read(most_bytes + 1))
    else:
        yield checked(posixpath.basename(name), raw)


def expanded(files: DataFrame) -> DataFrame:
    """files(path, content) -> archive, path, content, error: a bad archive gives a row with its error."""
    ship(files.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = [(name, p, c, None) for p, c in entries(name, bytes(raw))]
                except Exception as e:
                    out = [(name, None, None, str(e))]
                yield pd.DataFrame(out, columns=["archive", "path", "content", "error"])

    return files.select("path", "content").mapInPandas(work, "archive string, path string, content binary, error string")


def checkout(url: str, folder: str, branch: str | None = None) -> str:
    """Clones a repository into a folder on the driver and gives its head's hash."""
    on = ["--branch", branch] if branch else []
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *on, url, folder], check=True)
    return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash, length) of a checked-out tree, paths relative to it; `.git` is left out."""
    root = folder.rstrip("/").split(":", 1)[-1]
    rows = objects(spark, folder).where(~F.col("path").contains("/.git/"))
    return rows.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("path"), F.sha2("content", 256).alias("hash"), "length")


def scan(spark: SparkSession, path: str, order: list[str] | None = None, **terms) -> DataFrame:
    """A table filtered by equality; the filters reach the Parquet scan. No paging, no cap."""
    rows = spark.read.parquet(path)
    for name, value in terms.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order) if order else rows


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def merge(new: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Upsert into a table of Parquet files: last by `order` for each key. The new state is written
    beside the old one and takes its place when whole; until then the old one is only moved aside, so that a stop at
    any point leaves one of them whole (the old one as *-old)."""
    from tracewright.operators.relational import upsert

    spark = new.sparkSession
    fs, place, jpath = file_system(spark, path)
    rows = upsert(spark.read.parquet(path), new, keys, F.col(order)) if fs.exists(place) else upsert(new.limit(0), new, keys, F.col(order))
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    aside = jpath(f"{beside}-old")
    if fs.exists(place) and not fs.rename(place, aside):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(jpath(beside), place):
        fs.rename(aside, place)
        raise OSError(f"{beside} can't take the place of {path}")
    fs.delete(aside, True)


def delete_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Rewrites only the partitions that df holds, as what is left of them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def file_system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = make(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, make


def copy(spark: SparkSession, source: str, target: str) -> None:
    fs, a, make = file_system(spark, source)
    b = make(target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, b.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), b, False, spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> bool:
    fs, place, _ = file_system(spark, path)
    return fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, place, _ = file_system(spark, path)
    return fs.exists(place)


def ensure_table(spark: SparkSession, name: str, schema: str, by: list[str] | None = None) -> None:
    part = f" PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{part}")


def asserted_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; raises at once if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    if not twice.isEmpty():
        raise ValueError(f"keys repeat: {keys}")
    return df
