"""Archives as a data source: entries are read one by one, in bounded pieces, and never held whole.

    spark.dataSource.register(Archives)
    spark.read.format("archive").load("/mnt/archives")           # or any address that Arrow's file systems know

A task reads an archive (a zip's directory and the piece at hand; other formats stream), so memory doesn't grow with the
archive. The guards count unpacked bytes while they come, so they trip in the middle of an entry.

Rows: archive, path, part (from 0), content (at most `piece` bytes), error. An empty entry has one empty part. A damaged
archive, or one beyond its limits, or with an entry that leaves its folder, ends with a row of its error, after the pieces before it;
sound() leaves such archives out. A folder without files gives no rows."""

from __future__ import annotations

import gzip
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewright.session import ship
from tracewright.sources.files import MOST_BYTES, MOST_ENTRIES, MOST_RATIO

SCHEMA = "archive string, path string, part int, content binary, error string"
PIECE = 4 << 20


class Guard:
    """Limits of one archive, counted as it is unpacked."""

    def __init__(self, packed: int, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES, most_ratio: int = MOST_RATIO):
        self.packed, self.most_bytes, self.most_entries, self.most_ratio = max(1, packed), most_bytes, most_entries, most_ratio
        self.bytes = self.entries = 0

    def named(self, path: str) -> str:
        """The entry's clean path; raises where it leaves the archive."""
        clean = posixpath.normpath(path.replace("\\", "/"))
        if clean.startswith(("/", "..")) or ":" in clean.split("/")[0]:
            raise PermissionError(f"entry leaves the archive: {path}")
        self.entries += 1
        self.check()
        return clean

    def grown(self, n: int) -> None:
        self.bytes += n
        self.check()

    def check(self) -> None:
        if self.entries > self.most_entries or self.bytes > self.most_bytes or self.bytes // self.packed > self.most_ratio:
            raise ValueError("archive exceeds its limits")


def parts(stream, path: str, guard: Guard, piece: int) -> Iterator[tuple[str, int, bytes]]:
    """(path, part, content) of one entry; the next piece is read ahead of none."""
    part = 0
    while True:
        content = stream.read(piece)
        guard.grown(len(content))
        if content or not part:
            yield path, part, content
        if not content:
            return
        part += 1


def unpacked(name: str, file, guard: Guard, piece: int = PIECE) -> Iterator[tuple[str, int, bytes]]:
    """Pieces of the entries of a zip, tar (plain, gzip, bzip2, xz), gz or plain file."""
    low = name.lower()
    if low.endswith((".zip", ".jar")):
        with zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if not info.is_dir():
                    path = guard.named(info.filename)
                    with z.open(info) as stream:
                        yield from parts(stream, path, guard, piece)
    elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for member in t:
                t.members = []  # headers of entries read before, which the library would keep
                if member.isfile():
                    yield from parts(t.extractfile(member), guard.named(member.name), guard, piece)
    elif low.endswith(".gz"):
        with gzip.GzipFile(fileobj=file) as g:
            yield from parts(g, guard.named(posixpath.basename(name)[:-3]), guard, piece)
    else:
        yield from parts(file, guard.named(posixpath.basename(name)), guard, piece)


class Archive(InputPartition):
    def __init__(self, path: str, size: int):
        super().__init__((path, size))
        self.path, self.size = path, size


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.at = options["path"]
        self.piece = int(options.get("piece", PIECE))
        self.limits = {k: int(options.get(k, d)) for k, d in (("most_bytes", MOST_BYTES), ("most_entries", MOST_ENTRIES), ("most_ratio", MOST_RATIO))}

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.at)

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, root = self.place()
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        return [Archive(f.path, f.size) for f in sorted(found, key=lambda f: f.path)] or [Archive("", 0)]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = self.place()
        guard = Guard(partition.size, **self.limits)
        try:
            with system.open_input_file(partition.path) as file:
                for path, part, content in unpacked(partition.path, file, guard, self.piece):
                    yield partition.path, path, part, content, None
        except Exception as e:  # a damaged archive is a row, as are those beyond their limits
            yield partition.path, None, None, None, f"{type(e).__name__}: {e}"


class Archives(DataSource):
    """Options: path, piece (bytes), most_bytes, most_entries, most_ratio."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def archives(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The pieces of every archive below a folder. As many as a megabyte a row: batches of few rows."""
    ship(spark)
    spark.dataSource.register(Archives)
    return spark.read.format("archive").options(**{k: str(v) for k, v in options.items()}).load(path)


def sound(pieces: DataFrame) -> DataFrame:
    """The pieces of archives without an error."""
    bad = pieces.where("error is not null").select("archive").distinct()
    return pieces.where("error is null").join(bad, "archive", "left_anti")
