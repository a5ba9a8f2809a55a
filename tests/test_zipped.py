"""Archives read as streams: cut, nested, with descriptors, broken, too large."""

import io
import random
import zipfile

from runtrail.sources import zipped

TEXTS = {"a.json": b"1" * 3000, "b/c.json": bytes(random.Random(1).randbytes(200_000)), "d.json": b"", "e.txt": b"word " * 50_000}


class Unseekable(io.RawIOBase):
    """Makes the standard writer put sizes behind the members."""

    def __init__(self):
        super().__init__()
        self.data = bytearray()

    def writable(self):
        return True

    def write(self, part):
        self.data += part
        return len(part)


def archive(members, method=zipfile.ZIP_DEFLATED, streamed=False):
    target = Unseekable() if streamed else io.BytesIO()
    with zipfile.ZipFile(target, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return bytes(target.data) if streamed else target.getvalue()


def read(data, **options):
    rows = list(zipped.members(io.BufferedReader(io.BytesIO(data)), options.get("max_bytes", 1 << 30), depth=options.get("depth", 8)))
    return {n: c for n, c, r in rows if r is None}, [(n, r) for n, _, r in rows if r]


def test_members_equal_what_was_written():
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        assert read(archive(TEXTS, method)) == (TEXTS, [])
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2):
        assert read(archive(TEXTS, method, streamed=True)) == (TEXTS, [])
    nested = archive({"first": b"x", "in.zip": archive({"deep.json": b"2", "more.zip": archive(TEXTS)}, streamed=True), "last": b"y", "folder/": b"", "__MACOSX/z": b"z"}, streamed=True)
    good, bad = read(nested)
    assert good == {"first": b"x", "in.zip/deep.json": b"2", "last": b"y"} | {f"in.zip/more.zip/{k}": v for k, v in TEXTS.items()} and bad == []
    good, bad = read(nested, depth=1)
    assert good == {"first": b"x", "in.zip/deep.json": b"2", "last": b"y"} and bad == [("in.zip/more.zip", "archives nested too deep")]


def test_a_cut_archive_gives_what_comes_before():
    data = archive({f"m{i}": bytes(random.Random(i).randbytes(5000)) for i in range(5)})
    good, bad = read(data[:18_000])
    assert sorted(good) == ["m0", "m1", "m2"] and bad == [("m3", "archive cut")]
    for end in range(0, len(data), 97):  # wherever it is cut
        good, bad = read(data[:end])
        assert all(v == bytes(random.Random(int(k[1:])).randbytes(5000)) for k, v in good.items()) and (bad or len(good) == 5)
    outer = archive({"x": b"1", "in.zip": data}, zipfile.ZIP_STORED)
    good, bad = read(outer[:12_000])
    assert sorted(good) == ["in.zip/m0", "in.zip/m1", "x"] and [r for _, r in bad] == ["archive cut"] * 2
    assert read(b"no archive")[1] and read(b"")[1]


def test_rejected_members_do_not_hide_the_others():
    data = bytearray(archive({"a": b"a" * 9000, "b": bytes(random.Random(2).randbytes(9000)), "c": b"c"}))
    data[data.index(b"b", 60) + 2000] ^= 255  # within the bytes of b
    good, bad = read(bytes(data))
    assert sorted(good) == ["a", "c"] and bad == [("b", "member broken")]
    assert read(archive(TEXTS), max_bytes=5000) == ({"a.json": TEXTS["a.json"], "d.json": b""}, [("b/c.json", "member too large"), ("e.txt", "member too large")])
    secret = bytearray(archive({"a": b"a", "b": b"b"}, zipfile.ZIP_STORED))
    secret[6] |= 1
    assert read(bytes(secret)) == ({"b": b"b"}, [("a", "encrypted")])


def test_archives_of_a_folder_are_partitions(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.zip").write_bytes(archive({"a.json": b"1", "more.zip": archive({"deep.json": b"2"})}))
    (tmp_path / "sub" / "y.ZIP").write_bytes(archive({"b.json": b"3"})[:33])
    (tmp_path / "other.txt").write_bytes(b"no")
    good, bad = zipped.zipped_files(spark, str(tmp_path))
    assert good.rdd.getNumPartitions() == 2
    assert sorted((r["path"].split("/")[-1], r["member"], bytes(r["content"])) for r in good.collect()) == [("x.zip", "a.json", b"1"), ("x.zip", "more.zip/deep.json", b"2")]
    assert [(r["path"].split("/")[-1], r["reason"]) for r in bad.collect()] == [("y.ZIP", "archive cut")]
    assert zipped.zipped_files(spark, f"file:{tmp_path}/x.zip")[0].count() == 2
