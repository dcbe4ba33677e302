"""Trees of files as Spark data sources: inventories of any files, and subtitle documents, a file each.

Files are reached through pyarrow's file systems, so a path is local, shared, or a URI such as s3://, gs:// or hdfs://; stores that only
Spark's own readers open can't be listed here (assets.inventory_of takes their binaryFile rows).
The driver lists names and sizes; contents are read and written on the executors only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 4 << 20
#: Files that a commit moves at once.
MOVES = 16
#: A range of files is read by one task; a larger file has a task of its own.
RANGE_BYTES, RANGE_FILES = 128 << 20, 1000
INVENTORY = "name string, url string, bytes long, sha256 string, required boolean"
DOCUMENTS = "file_name string, srt_text string, bytes long"


@dataclass
class FileRange(InputPartition):
    """Files of a tree, by their paths below its top."""

    files: list[str]


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written aside: its folder, and their names below it."""

    folder: str
    files: list[str]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path there."""
    files, top = fs.FileSystem.from_uri(path)
    return files, top.rstrip("/")


def below(path: str) -> list[tuple[str, int]]:
    """(path below the top, size) of every regular file that isn't hidden, in the order of their parts; none where there is no such folder."""
    files, top = opened(path)
    found = files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
    rows = [(i.path[len(top) + 1 :], i.size) for i in found if i.type == fs.FileType.File]
    return sorted((r for r in rows if not any(p.startswith(".") for p in r[0].split("/"))), key=lambda r: r[0].split("/"))


def ranges(rows: list[tuple[str, int]]) -> list[FileRange]:
    out, held = [FileRange([])], 0
    for name, size in rows:
        if out[-1].files and (held + size > RANGE_BYTES or len(out[-1].files) == RANGE_FILES):
            out.append(FileRange([]))
            held = 0
        out[-1].files.append(name)
        held += size
    return out


class TreeReader(DataSourceReader):
    """Hashes the files of a tree in chunks, so that a file may be larger than memory."""

    def __init__(self, path: str, root: str):
        self.path, self.root = path, root

    def partitions(self) -> list[FileRange]:
        rows = below(self.path)
        if not rows:
            raise ValueError(f"No packaged model files found in {self.path}")
        return ranges(rows)

    def read(self, partition: FileRange) -> Iterator[tuple]:
        files, top = opened(self.path)
        inner = top[len(opened(self.root)[1]) + 1 :]
        for name in partition.files:
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(f"{top}/{name}", compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            yield PurePosixPath(name).stem, f"{inner}/{name}" if inner else name, size, digest.hexdigest(), True


class AssetTree(DataSource):
    """Format asset_tree: (name, url, bytes, sha256, required) of the files under a path; option root: what URLs are relative to, the path itself by default."""

    @classmethod
    def name(cls) -> str:
        return "asset_tree"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema: StructType) -> TreeReader:
        path = self.options["path"]
        root = self.options.get("root", path)
        if not f"{opened(path)[1]}/".startswith(f"{opened(root)[1]}/"):
            raise ValueError(f"{path} is not under {root}")
        return TreeReader(path, root)


class SubtitleReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[FileRange]:
        if self.path.endswith(self.suffix):  # a single file
            return [FileRange([""])]
        return ranges([r for r in below(self.path) if r[0].endswith(self.suffix) and not r[0].startswith("_")])

    def read(self, partition: FileRange) -> Iterator[tuple]:
        files, top = opened(self.path)
        for name in partition.files:
            with files.open_input_stream(f"{top}/{name}".rstrip("/"), compression=None) as stream:
                content = stream.read()
            yield name or PurePosixPath(top).name, content.decode("utf-8", "replace"), len(content)


class SubtitleWriter(DataSourceWriter):
    """Each task writes into a folder of its own; only the folders of tasks that counted are moved into place, so repeated and lost tasks leave nothing behind."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        files, top = opened(self.path)
        folder, names = f"{top}/{self.job}/{uuid.uuid4().hex}", []
        for row in rows:
            name = row["file_name"]
            if not name or not name.endswith(self.suffix) or name.startswith(("/", "_")) or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"not the name of a subtitle file: {name}")
            files.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(f"{folder}/{name}", compression=None) as stream:
                stream.write((row["srt_text"] or "").encode())
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, top = opened(self.path)
        staged = [m for m in messages if m is not None]
        names = [n for m in staged for n in m.files]
        if len(set(names)) < len(names):
            raise ValueError("two documents have one file name")
        old = {n for n, _ in below(self.path) if n.endswith(self.suffix) and not n.startswith("_")} if self.overwrite else set()
        for folder in {n.rsplit("/", 1)[0] for n in names if "/" in n} | {""}:
            files.create_dir(f"{top}/{folder}".rstrip("/"), recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:  # each waits for the store
            list(pool.map(lambda m: files.move(f"{m[0]}/{m[1]}", f"{top}/{m[1]}"), ((m.folder, name) for m in staged for name in m.files)))
            list(pool.map(lambda name: files.delete_file(f"{top}/{name}"), old - set(names)))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, top = opened(self.path)
        if files.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/{self.job}")


class SubtitleFiles(DataSource):
    """Format subtitle_files: (file_name, srt_text, bytes) of the subtitle files under a path, and their writer, a file for each row (file_name, srt_text)."""

    @classmethod
    def name(cls) -> str:
        return "subtitle_files"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema: StructType) -> SubtitleReader:
        return SubtitleReader(self.options["path"], self.options.get("suffix", ".srt"))

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        return SubtitleWriter(self.options["path"], self.options.get("suffix", ".srt"), overwrite)


def file_inventory(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """SRC-6. (name, url, bytes, sha256, required) of the files under path, in the order of their path's parts.

    Files under a dot name are left out, names with an underscore are not; an empty tree or none is an error. URLs are relative to root.
    """
    spark.dataSource.register(AssetTree)
    reader = spark.read.format("asset_tree")
    return (reader.option("root", root) if root else reader).load(path)  # ranges of files are in order, and so are the rows in each


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4, the files. (track_id, srt_text, bytes): the name below the path, without its suffix, is the track; bytes are those of the file, a byte order mark included."""
    spark.dataSource.register(SubtitleFiles)
    rows = spark.read.format("subtitle_files").load(path)
    return rows.select(F.regexp_replace("file_name", r"\.srt$", "").alias("track_id"), "srt_text", "bytes")


def stream_srt(spark: SparkSession, path: str) -> DataFrame:
    """read_srt as a stream of the files that come. Spark's own file source keeps the log of what it has seen: names are the only order that files moved into place have."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.srt$", "").alias("track_id"), F.decode("content", "UTF-8").alias("srt_text"), F.col("length").alias("bytes"))


def write_srt(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1, the files. A file for each document (file_name, srt_text) under path; names end in .srt and are unique, else nothing is written."""
    documents.sparkSession.dataSource.register(SubtitleFiles)
    documents.select(F.col("file_name"), F.col("srt_text"), F.octet_length("srt_text").cast("long").alias("bytes")).write.format("subtitle_files").mode(mode).save(path)
