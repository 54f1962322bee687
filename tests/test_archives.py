"""Archives as a data source, in pieces."""

import gzip
import io
import tarfile
import zipfile

import pytest

from tracewright.sources import archives


def filled(folder):
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("src/One.java", "x" * 2500)
        z.writestr("empty.txt", "")
    with tarfile.open(folder / "b.tar.gz", "w:gz") as t:
        for name, content in (("one.log", b"first"), ("two.log", b"second" * 300)):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    (folder / "deep").mkdir()
    (folder / "deep" / "c.log.gz").write_bytes(gzip.compress(b"lines"))
    (folder / "plain.txt").write_bytes(b"as it is")
    (folder / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    with zipfile.ZipFile(folder / "leaves.zip", "w") as z:
        z.writestr("fine.txt", "fine")
        z.writestr("../outside.txt", "bad")


def test_entries_come_in_pieces(spark, tmp_path):
    filled(tmp_path)
    rows = archives.archives(spark, str(tmp_path), piece=1000).collect()
    whole = {}
    for r in sorted((r for r in rows if r["error"] is None), key=lambda r: (r["archive"], r["path"], r["part"])):
        assert len(r["content"]) <= 1000
        key = (r["archive"].rsplit("/", 1)[-1], r["path"])
        whole[key] = whole.get(key, b"") + bytes(r["content"])
    assert whole == {
        ("a.zip", "src/One.java"): b"x" * 2500, ("a.zip", "empty.txt"): b"", ("b.tar.gz", "one.log"): b"first", ("b.tar.gz", "two.log"): b"second" * 300,
        ("c.log.gz", "c.log"): b"lines", ("plain.txt", "plain.txt"): b"as it is", ("leaves.zip", "fine.txt"): b"fine",
    }
    bad = {r["archive"].rsplit("/", 1)[-1]: r["error"] for r in rows if r["error"]}
    assert set(bad) == {"broken.zip", "leaves.zip"} and "leaves the archive" in bad["leaves.zip"]
    kept = archives.sound(archives.archives(spark, str(tmp_path))).select("archive").distinct().collect()
    assert {r["archive"].rsplit("/", 1)[-1] for r in kept} == {"a.zip", "b.tar.gz", "c.log.gz", "plain.txt"}


def test_no_archives(spark, tmp_path):
    assert archives.archives(spark, str(tmp_path)).count() == 0


class Counted(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        self.asked += max(0, n)
        return super().read(n)


@pytest.mark.parametrize("limits", [{"most_bytes": 50_000}, {"most_ratio": 20}])
def test_guards_trip_in_the_middle_of_an_entry(limits):
    raw = gzip.compress(b"\0" * 20_000_000)
    guard = archives.Guard(len(raw), **limits)
    seen = 0
    with pytest.raises(ValueError):
        for _, _, content in archives.unpacked("bomb.gz", io.BytesIO(raw), guard, 10_000):
            seen += len(content)
    assert seen < 1_000_000


def test_many_entries_stop_at_the_limit():
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for i in range(30):
            t.addfile(tarfile.TarInfo(f"e{i}"), io.BytesIO())
    held.seek(0)
    with pytest.raises(ValueError):
        list(archives.unpacked("many.tar", held, archives.Guard(10_240, most_entries=10)))


def test_a_large_entry_takes_little_memory():
    import tracemalloc

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open("large.bin", "w") as f:
        for i in range(64):
            f.write(bytes([i]) * (1 << 20))
    tracemalloc.start()
    size = sum(len(c) for _, _, c in archives.unpacked("large.zip", raw, archives.Guard(1 << 20), 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == 64 << 20 and peak < 12 << 20
