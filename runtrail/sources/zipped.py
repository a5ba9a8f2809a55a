"""Members of zip archives as rows, read as a stream: a Python data source with one partition per archive.

Local headers are taken one after the other, so an archive that was cut gives the members before the tear; archives within archives
are read through the stream that inflates them. No archive is held whole, a member is once it is a row. What gives no row of content
gives one with a reason instead: the member at which an archive is cut, members over the cap, broken or encrypted ones, archives
nested too deep.
"""

from __future__ import annotations

import bz2
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "path string, member string, content binary, reason string"
MAX_BYTES, MAX_DEPTH, STEP = 512 << 20, 8, 1 << 16
HEADER = struct.Struct("<4s5H3I2H")
LOCAL, DESCRIPTOR, WIDE = b"PK\x03\x04", b"PK\x07\x08", 0xFFFFFFFF


class Torn(Exception):
    """The stream ends within a member."""


class Broken(Exception):
    """A member's bytes are not what its method says."""


class Unpacked(io.RawIOBase):
    """The plain bytes of the member that begins at ``packed``; reads no byte beyond it. ``size`` is its packed size if known."""

    def __init__(self, packed: io.BufferedReader, method: int, size: int | None):
        super().__init__()
        self.packed, self.left, self.crc, self.count, self.held = packed, size, 0, 0, b""
        self.engine = {0: None, 8: zlib.decompressobj(-15) if method == 8 else None, 12: bz2.BZ2Decompressor() if method == 12 else None}[method]
        self.stored = method == 0

    def readable(self) -> bool:
        return True

    def ended(self) -> bool:
        return self.left == 0 if self.stored else self.engine.eof

    def readinto(self, room) -> int:
        while not self.held and not self.ended():
            limit = STEP if self.left is None else min(self.left, STEP)
            ahead = self.packed.peek(1)[:limit] if limit else b""
            if not ahead and limit:
                raise Torn
            self.held, used = self.advance(ahead, len(room))
            self.packed.read(used)
            if self.left is not None:
                self.left -= used
        made, self.held = self.held[: len(room)], self.held[len(room) :]
        room[: len(made)] = made
        self.crc, self.count = zlib.crc32(made, self.crc), self.count + len(made)
        return len(made)

    def advance(self, ahead: bytes, most: int) -> tuple[bytes, int]:
        """(plain bytes, packed bytes used) of what lies ahead."""
        if self.stored:
            return ahead[:most], min(len(ahead), most)
        try:
            if isinstance(self.engine, bz2.BZ2Decompressor):  # keeps what it was given: small pieces, and all that they hold
                if not ahead:
                    raise Broken
                return self.engine.decompress(ahead[:512]), len(ahead[:512]) - len(self.engine.unused_data)
            made = self.engine.decompress(ahead, most)
        except (zlib.error, OSError) as error:
            raise Broken from error
        if not ahead and not made and not self.engine.eof:
            raise Broken  # the size of the header ends before the data does
        return made, len(ahead) - len(self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail)

    def skip_packed(self) -> None:
        """Go to the end of a member whose packed size is known."""
        while self.left:
            got = self.packed.read(min(self.left, STEP))
            if not got:
                raise Torn
            self.left -= len(got)


class Again(io.RawIOBase):
    """A stream with the bytes that were read from it put back."""

    def __init__(self, head: bytes, rest: io.BufferedReader):
        super().__init__()
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        made, self.head = (self.head[: len(room)], self.head[len(room) :]) if self.head else (self.rest.read1(len(room)), b"")
        room[: len(made)] = made
        return len(made)


@dataclass
class Header:
    name: str
    flags: int
    method: int
    crc: int
    packed: int | None
    wide: bool


def next_header(stream: io.BufferedReader) -> Header | None:
    """The local header at the stream's place; None where members end."""
    raw = stream.read(HEADER.size)
    if raw[:4] != LOCAL:
        if raw[:2] == b"PK" and len(raw) >= 4:
            return None
        raise Torn
    if len(raw) < HEADER.size:
        raise Torn
    _, _, flags, method, _, _, crc, packed, plain, name_length, extra_length = HEADER.unpack(raw)
    name, extra = stream.read(name_length), stream.read(extra_length)
    if len(name) + len(extra) < name_length + extra_length:
        raise Torn
    at, wide = 0, False
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1 and WIDE in (packed, plain):
            wide = True
            values = struct.unpack_from(f"<{length // 8}Q", extra, at + 4)
            if packed == WIDE and values:
                packed = values[-1 if plain == WIDE else 0]
        at += 4 + length
    text = name.decode("utf-8", "replace") if flags & 0x800 else name.decode("cp437")
    return Header(text, flags, method, crc, None if flags & 8 and not packed else packed, wide)


def end_of(stream: io.BufferedReader, header: Header) -> int | None:
    """The checksum after a member that is followed by one; its header's otherwise."""
    if not header.flags & 8:
        return header.crc
    first = stream.read(4)
    if first == DESCRIPTOR:
        first = stream.read(4)
    stream.read(16 if header.wide else 8)
    return struct.unpack("<I", first)[0] if len(first) == 4 else None


def members(stream: io.BufferedReader, max_bytes: int, prefix: str = "", depth: int = MAX_DEPTH) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, reason) of every file in an archive's stream, up to where it ends or is cut."""
    name = prefix.rstrip("/")
    try:
        while (header := next_header(stream)) is not None:
            name = prefix + header.name
            if header.method not in (0, 8, 12) or (header.method == 0 and header.packed is None) or header.flags & 1:
                yield name, None, "encrypted" if header.flags & 1 else "method not supported"
                if header.packed is None:
                    return  # where it ends is not known
                Unpacked(stream, 0, header.packed).skip_packed()
                end_of(stream, header)
                continue
            plain = Unpacked(stream, header.method, header.packed)
            try:
                yield from one_member(plain, stream, header, name, max_bytes, depth)
            except Broken:
                yield name, None, "member broken"
                if header.packed is None:
                    return
                plain.skip_packed()
                end_of(stream, header)
    except Torn:
        yield name, None, "archive cut"


def one_member(plain: Unpacked, stream: io.BufferedReader, header: Header, name: str, max_bytes: int, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    buffered = io.BufferedReader(plain, STEP)
    folder = name.endswith("/") or name.split("/")[0] == "__MACOSX"
    head = buffered.read(4)
    inner = not folder and head == LOCAL
    content: bytes | None = None
    if inner and depth:
        yield from members(io.BufferedReader(Again(head, buffered), STEP), max_bytes, f"{name}/", depth - 1)
    elif not folder and not inner:
        content = head + buffered.read(max(0, max_bytes - 3))
    while buffered.read(STEP):
        pass
    crc = end_of(stream, header)
    if inner and not depth:
        yield name, None, "archives nested too deep"
    if content is None:
        return
    if plain.count > max_bytes:
        yield name, None, "member too large"
    elif crc is not None and crc != plain.crc:
        yield name, None, "member broken"
    else:
        yield name, content, None


def located(path: str):
    """(file system, path) of a path or URI, as Spark writes them."""
    from pyarrow import fs

    local = re.match(r"^file:/+", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), "/" + path[local.end() :] if local else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def partitions(self) -> list[Archive]:
        """One per archive, of a folder all ``*.zip`` beneath it in the order of their names."""
        from pyarrow import fs

        system, path = located(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [Archive(self.path)]
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file:"
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [Archive(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".zip")]

    def read(self, partition: Archive) -> Iterator[tuple[str, str, bytes | None, str | None]]:
        if partition is None or not isinstance(partition, Archive):
            return
        system, path = located(partition.path)
        with system.open_input_stream(path, buffer_size=1 << 20) as raw:
            for name, content, reason in members(io.BufferedReader(raw, STEP), self.max_bytes):
                yield partition.path, name, content, reason


class ZippedSource(DataSource):
    """``spark.read.format("zipped").option("max_bytes", n).load(folder or archive)``."""

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)))


def zipped_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, member, content), rejects (path, member, reason)) of all archives under a path."""
    spark.dataSource.register(ZippedSource)
    rows = spark.read.format("zipped").option("max_bytes", max_bytes).load(path)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "member", "reason")
