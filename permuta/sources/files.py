"""Named text files as a sink, and digests of files of any size: Spark deals the work, each task streams.

Files are opened with Arrow's file systems (local and mounted folders, HDFS, S3, GCS), since Spark's own writers name
their files themselves and its readers hold a whole binary file in a row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes read at once.
BLOCK = 4 << 20


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Rows (name, line), those of a name together, into files of a new folder that appears when all tasks have ended."""

    def __init__(self, path: str, header: str | None):
        self.path, self.header, self.staging = path.rstrip("/"), header, f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _open(self.staging)
        fs.create_dir(root, recursive=True)
        names, out = [], None
        for name, line in iterator:
            if not names or name != names[-1]:
                if out is not None:
                    out.close()
                if not name or "/" in name or name in names:
                    raise ValueError(f"no file can be named {name!r}" if not name or "/" in name else f"the lines of {name} aren't together")
                names.append(name)
                # A task that is tried again writes its files anew.
                out = fs.open_output_stream(f"{root}/{name}")
                if self.header:
                    out.write(self.header.encode() + b"\n")
            out.write(line.encode() + b"\n")
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.staging)
        names = [n for m in messages if m is not None for n in m.names]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one file")
        fs.create_dir(root, recursive=True)
        target = _open(self.path)[1]
        from pyarrow.fs import FileType

        if fs.get_file_info(target).type != FileType.NotFound:
            fs.delete_dir(target)
        fs.move(root, target)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = _open(self.staging)
        if fs.get_file_info(root).type != FileType.NotFound:
            fs.delete_dir(root)


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("header", ...).mode("overwrite").save(folder)`` of (name, line)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("header"))


def write_named_files(lines: DataFrame, folder: str, header: str | None = None, order: list[str] | None = None) -> None:
    """``lines`` (name, line) as one file a name, lines in ``order`` (by themselves if none is given); an old folder is replaced.

    All files appear at once by one rename of their folder, or none does.  A file is written by one task as a stream, sorted by
    Spark's spilling sort.  A name with a slash raises.
    """
    lines.sparkSession.dataSource.register(NamedFiles)
    rows = lines.repartition("name").sortWithinPartitions("name", *(order or ["line"])).select("name", "line")
    writer = rows.write.format("named_files").mode("overwrite")
    if header is not None:
        writer = writer.option("header", header)
    writer.save(folder)


def file_digests(spark: SparkSession, path: str, glob: str = "*", block: int = BLOCK) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path`` that fits the glob, empty ones apart, which Spark doesn't list; a task holds ``block`` bytes of a file."""
    # Only names and lengths are asked for, so Spark opens no file here.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")

    def run(batches):
        for batch in batches:
            sums = []
            for name, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, inside = _open(name)
                total = hashlib.sha256()
                with fs.open_input_stream(inside) as stream:
                    while data := stream.read(block):
                        total.update(data)
                sums.append((name, length, total.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sums], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "bytes", "sha256"])

    return files.repartition(F.col("path")).mapInArrow(run, "path string, bytes long, sha256 string")


def stream_digests(lines: DataFrame, order: list[str]) -> DataFrame:
    """(series_id, sha256) of each series' lines in order, joined by line feeds; hashed as a stream, no row holds them all."""
    kind = lines.schema["series_id"].dataType.simpleString()

    def run(batches):
        current, total, first = None, None, True
        names = ["series_id", "sha256"]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([total.hexdigest()])], names)

        for batch in batches:
            for sid, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if total is None or sid != current:
                    if total is not None:
                        yield row()
                    current, total, first = sid, hashlib.sha256(), True
                total.update((line if first else "\n" + line).encode())
                first = False
        if total is not None:
            yield row()

    rows = lines.repartition("series_id").sortWithinPartitions("series_id", *order)
    return rows.select("series_id", "line").mapInArrow(run, f"series_id {kind}, sha256 string")
