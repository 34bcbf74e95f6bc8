"""ZIP archives of any size as data sources: members read by several tasks, and archives written as streams.

Reading is planned from an archive's central directory, at its end: members are
dealt to partitions by their compressed sizes, and a task reads only its own
stretch of the file.  Nothing holds an archive.  Writing gives one archive for
each name, by the task that has its rows; files get their names when all tasks
have ended well, so a failed task or job leaves none.

Paths are local or of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vellum.operators import files as paths
from vellum.session import ship
from vellum.sources.files import archive_members, listing

MEMBERS = "archive string, member string, content binary, error string"
#: The largest archive and member that are read.
MOST_BYTES, MOST_MEMBER_BYTES = 60_000 * 2**20, 5_000 * 2**20
#: A cell of a table holds less than this.
MOST_CELL_BYTES = 2**31 - 1024
#: Archives from this size on are read by members, and compressed bytes of a partition of them.
LARGE_BYTES, SPLIT_BYTES = 256 * 2**20, 64 * 2**20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Stretch(InputPartition):
    """Members of an archive that lie together: (name, offset of the local header, compressed size, size, method, flags, crc); or an error."""

    def __init__(self, path: str, members: list[tuple], error: str | None = None):
        self.path, self.members, self.error = path, members, error


def planned(path: str, most_bytes: int, split_bytes: int) -> list[Stretch]:
    """The members of an archive in stretches of about split_bytes compressed bytes."""
    try:
        system, name = located(path)
        size = system.get_file_info(name).size
        if size is None:
            raise FileNotFoundError(path)
        if size > most_bytes:
            raise ValueError("archive is too large")
        with system.open_input_file(name) as f, zipfile.ZipFile(f) as z:
            infos = sorted(z.infolist(), key=lambda i: i.header_offset)
    except Exception as e:
        return [Stretch(path, [], f"{type(e).__name__}: {e}")]
    out: list[Stretch] = []
    now: list[tuple] = []
    held = 0
    for i in infos:
        if now and held + i.compress_size > split_bytes:
            out.append(Stretch(path, now))
            now, held = [], 0
        now.append((i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC))
        held += i.compress_size
    return out + ([Stretch(path, now)] if now else [])


def content_of(f, offset: int, packed: int, size: int, method: int, flags: int, crc: int) -> bytes:
    """A member's bytes, by its local header."""
    if flags & 1:
        raise ValueError("member is encrypted")
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at its place")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    raw = f.read(packed)
    if method == zipfile.ZIP_STORED:
        out = raw
    elif method == zipfile.ZIP_DEFLATED:
        unpacker = zlib.decompressobj(-15)
        out = unpacker.decompress(raw, size + 1)
    else:
        raise ValueError(f"unknown compression {method}")
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("member is damaged")
    return out


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.most_bytes, self.most_member = int(options.get("mostbytes", MOST_BYTES)), int(options.get("mostmemberbytes", MOST_MEMBER_BYTES))
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [s for p in self.paths for s in planned(p, self.most_bytes, self.split_bytes)] or [Stretch("", [])]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, None, None, partition.error
        if not partition.members:
            return
        system, name = located(partition.path)
        with system.open_input_file(name) as f:
            for member, offset, packed, size, method, flags, crc in partition.members:
                if member.endswith("/"):
                    yield partition.path, member, None, None
                    continue
                try:
                    if size > min(self.most_member, MOST_CELL_BYTES):
                        raise ValueError("member is too large")
                    content, error = content_of(f, offset, packed, size, method, flags, crc), None
                except Exception as e:
                    content, error = None, f"{type(e).__name__}: {e}"
                yield partition.path, member, content, error


class Written(WriterCommitMessage):
    """Archives of a task: (temporary path, final path), both on the writer's file system."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class ArchiveWriter(DataSourceWriter):
    """Rows of archive, member, content; those of an archive must come one after the other, to one task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = located(self.path)
        return system, folder, f"{folder}/.writing-{self.job}"

    def write(self, rows: Iterator) -> Written:
        system, folder, scratch = self._folder()
        system.create_dir(scratch, recursive=True)
        done: list[tuple[str, str]] = []
        seen: set[str] = set()
        name = out = archive = None
        try:
            for row in rows:
                if row["archive"] is None:
                    raise ValueError("an archive needs a name")
                if row["archive"] != name:
                    if archive is not None:
                        archive.close()
                        out.close()
                    name = row["archive"]
                    if name in seen:
                        raise ValueError(f"rows of {name!r} don't follow each other")
                    if not name or name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/"):
                        raise ValueError(f"bad name of an archive: {name!r}")
                    seen.add(name)
                    held = f"{scratch}/{uuid.uuid4().hex}"
                    done.append((held, f"{folder}/{name}"))
                    out = system.open_output_stream(held)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if row["content"] is not None and row["member"] is not None:
                    archive.writestr(zipfile.ZipInfo(row["member"]), bytes(row["content"]), zipfile.ZIP_DEFLATED)
            if archive is not None:
                archive.close()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for held, _ in done:
                _removed(system, held)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, scratch = self._folder()
        files = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in files}) != len(files):
            self.abort(messages)
            raise ValueError("rows of one archive came to several tasks")
        for held, final in files:
            system.create_dir(final.rpartition("/")[0], recursive=True)
            system.move(held, final)
        _removed(system, scratch)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, scratch = self._folder()
        _removed(system, scratch)


def _removed(system: fs.FileSystem, path: str) -> None:
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


class ZipArchives(DataSource):
    """Format ``zip``.  Reading: option ``paths``, a JSON list of archives; writing: option ``path``, a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ZipArchives)


def read_large(spark: SparkSession, archives: list[str], split_bytes: int = SPLIT_BYTES, most_bytes: int = MOST_BYTES, most_member_bytes: int = MOST_MEMBER_BYTES) -> DataFrame:
    """Usable members of archives by path: archive, member, content, error; a partition for each stretch of about split_bytes."""
    register(spark)
    rows = spark.read.format("zip").option("paths", json.dumps(archives)).option("splitbytes", split_bytes).option("mostbytes", most_bytes).option("mostmemberbytes", most_member_bytes).load()
    rows = rows.withColumn("member", paths.normalised(F.col("member")))
    return rows.where(F.col("member").isNull() | paths.safe(F.col("member")))


def read(spark: SparkSession, folder: str, pattern: str = "*.zip", large_bytes: int = LARGE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Usable members of all archives below a folder: small ones whole, a row of Spark's own reader each, large ones by members.

    The driver gets the paths of large archives only: one for each ``large_bytes`` of input at most.
    """
    sizes = listing(spark, folder, pattern)
    large = [r["path"] for r in sizes.where(F.col("length") >= large_bytes).select("path").collect()]
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).where(F.col("length") < large_bytes)
    small = archive_members(whole.select("path", "content"))
    return small.unionByName(read_large(spark, large, split_bytes)) if large else small


def save(rows: DataFrame, folder: str) -> None:
    """Rows (archive, member, content) as one archive for each name below folder; rows without content are left out.

    The members of an archive stand in the order of their names.  An archive is
    one stream by one task, which holds a member at a time.
    """
    register(rows.sparkSession)
    dealt = rows.select("archive", "member", F.col("content").cast("binary").alias("content")).repartition("archive").sortWithinPartitions("archive", "member")
    dealt.write.format("zip").option("path", folder).mode("append").save()
