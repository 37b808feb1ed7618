"""A data source of project files: folders or packed archives, filtered before a file is opened.

``root/<project>/...`` is read in one partition per project and slice, ``root/<project>[@n].tar[.gz]`` in
one per archive. The driver lists the root alone; a task lists its own project, does not enter ignored
folders, and opens the files that are wanted only.
"""

from __future__ import annotations

import json
import re
import sys
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from zlib import crc32

# Tasks get this module by value, so executors need pyarrow but not the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "project_id string, path string, size_bytes bigint, mtime double, content binary"
ARCHIVE = re.compile(r"^(.+?)(?:@[^@]*)?\.tar(?:\.gz)?$")
BATCH_BYTES = 8 << 20


@dataclass
class Part(InputPartition):
    project: str
    place: str
    archive: bool
    piece: int = 0


class Wanted:
    """Which files are read, by path and size."""

    def __init__(self, patterns: list[str], anchor: bool, extensions: list[str] | None, max_size: int | None):
        if anchor:
            patterns = [p if p.endswith("$") else f"^(?:{p})$" for p in patterns]
        self.ignored = re.compile("|".join(f"(?:{p})" for p in patterns)) if patterns else None
        self.extensions, self.max_size = None if extensions is None else set(extensions), max_size

    def enters(self, folder: str) -> bool:
        return self.ignored is None or not self.ignored.search(folder)

    def takes(self, path: str, size: int) -> bool:
        *folders, name = path.split("/")
        if not size or (self.max_size is not None and size > self.max_size):
            return False
        bare = name.lstrip(".")
        if self.extensions is not None and (bare.rpartition(".")[2] if "." in bare else "") not in self.extensions:
            return False
        return self.ignored is None or not (any(map(self.ignored.search, (*folders, name)))
                                            or self.ignored.search("/".join(folders)))


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.slices = int(options.get("slices", "1"))
        self.with_content = options.get("content", "true") == "true"
        self.projects = json.loads(options.get("projects", "null"))
        self.wanted = Wanted(json.loads(options.get("ignore", "[]")), options.get("anchor", "false") == "true",
                             json.loads(options.get("extensions", "null")), json.loads(options.get("maxsize", "null")))

    def partitions(self) -> list[Part]:
        system, root = fs.FileSystem.from_uri(self.root)
        parts = []
        for entry in system.get_file_info(fs.FileSelector(root)):
            packed = ARCHIVE.match(entry.base_name)
            if entry.type == fs.FileType.Directory and not entry.base_name.startswith("_temporary"):
                parts += [Part(entry.base_name, entry.path, False, k) for k in range(self.slices)]
            elif packed:
                parts.append(Part(packed[1], entry.path, True))
        return [p for p in parts if self.projects is None or p.project in self.projects]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        rows = self._archived(system, partition) if partition.archive else self._files(system, partition)
        held, size = [], 0
        for row in rows:
            held.append((partition.project, *row))
            size += len(row[-1] or b"") + 100
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _files(self, system: fs.FileSystem, partition: Part) -> Iterator[tuple]:
        folders = [partition.place]
        while folders:
            for entry in system.get_file_info(fs.FileSelector(folders.pop())):
                path = entry.path[len(partition.place) + 1:]
                if entry.type == fs.FileType.Directory:
                    if self.wanted.enters(entry.base_name):
                        folders.append(entry.path)
                elif entry.type == fs.FileType.File and crc32(path.encode()) % self.slices == partition.piece \
                        and self.wanted.takes(path, entry.size):
                    content = self._opened(system, entry.path) if self.with_content else None
                    yield path, entry.size, entry.mtime.timestamp() if entry.mtime else None, content

    def _opened(self, system: fs.FileSystem, path: str) -> bytes:
        with system.open_input_stream(path, compression=None) as stream:
            return stream.readall()

    def _archived(self, system: fs.FileSystem, partition: Part) -> Iterator[tuple]:
        with system.open_input_stream(partition.place, compression=None) as stream, \
                tarfile.open(fileobj=stream, mode="r|*") as archive:
            for member in archive:
                path = member.name.removeprefix("./")
                if member.isfile() and self.wanted.takes(path, member.size):
                    content = archive.extractfile(member).read() if self.with_content else None
                    yield path, member.size, float(member.mtime), content


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)],
                                      names=[c.split()[0] for c in SCHEMA.split(", ")])


class CorpusSource(DataSource):
    """Options: ``path``, ``ignore`` and ``extensions`` and ``projects`` (JSON lists), ``anchor``, ``maxsize``,
    ``slices`` (tasks per project folder), ``content`` (false lists without opening)."""

    @classmethod
    def name(cls) -> str:
        return "project_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(dict(self.options))


def read_files(spark: SparkSession, root: str, ignore: list[str], anchor: bool = False,
               extensions: list[str] | None = None, max_file_size: int | None = None, slices: int = 1,
               content: bool = True) -> DataFrame:
    """``project_id, path, size_bytes, mtime, content`` of the wanted files below ``root``; empty ones are left out."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("project_files").options(
        path=root, ignore=json.dumps(list(ignore)), anchor=str(anchor).lower(), slices=str(slices),
        extensions=json.dumps(extensions), maxsize=json.dumps(max_file_size), content=str(content).lower()).load()


def _member(path: str, mtime: float, content: bytes) -> bytes:
    """Header and blocks of one file. A whole time is written as a whole number, which needs no second header."""
    member = tarfile.TarInfo(path)
    member.size, member.mtime = len(content), int(mtime) if float(mtime).is_integer() else mtime
    return b"".join((member.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape"), content,
                     bytes(-len(content) % tarfile.BLOCKSIZE)))


def pack(files: DataFrame, root: str) -> None:
    """Writes ``files(project_id, path, mtime, content)`` as archives: several per project where tasks share one.

    An archive gets its final name when it is complete, so an interrupted task leaves nothing behind that counts.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        project, stream, temporary, done = None, None, "", []

        def close():
            stream.write(bytes(-stream.tell() % tarfile.RECORDSIZE or tarfile.RECORDSIZE))
            stream.close()
            name = f"{project}@{TaskContext.get().partitionId():06d}.tar"
            system.move(temporary, f"{folder}/{name}")
            done.append(name)

        for batch in batches:
            for name, path, mtime, content in zip(*(c.to_pylist() for c in batch.columns)):
                if name != project:
                    if stream:
                        close()
                    project, temporary = name, f"{folder}/_temporary-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary, compression=None, buffer_size=BATCH_BYTES)
                stream.write(_member(path, mtime or 0, content))
        if stream:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    files.selectExpr("cast(project_id as string) as project_id", "path", "mtime", "cast(content as binary) as content") \
        .repartitionByRange("project_id", "path").sortWithinPartitions("project_id", "path") \
        .mapInArrow(write, "archive string").write.format("noop").mode("overwrite").save()
