"""Data sources for arrays in .npz files: keyed arrays, written and read; point clouds, read with their label.

Register once a session: ``arrays.register(spark)``; then ``rows.write.format("keyed_arrays").save(path)``, ``spark.read.format("point_clouds").load(path)``.
Paths may be local ones that all machines share or of any store that pyarrow reaches by URI.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PART_BYTES = 32 << 20  # of files that one task reads


def register(spark: SparkSession) -> None:
    for source in (KeyedArrays, PointClouds):
        spark.dataSource.register(source)


def _at(path: str):
    """The file system and the path on it."""
    from pyarrow import fs

    scheme = re.match(r"([a-z][a-z0-9+.-]*):/*", path)
    if not scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + path[scheme.end() :]
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _dealt(found: list) -> list[Files]:
    """File infos in groups of about PART_BYTES, in order of path."""
    groups, size = [], PART_BYTES
    for info in sorted(found, key=lambda f: f.path):
        if size >= PART_BYTES:
            groups.append(Files([]))
            size = 0
        groups[-1].paths.append(info.path)
        size += info.size or 0
    return groups


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    partition: int


class KeyedArrays(DataSource):
    """Rows (key string, values array<double>) as .npz files of 16-bit floats, one array a key, one file a task.

    A task streams its arrays into a hidden file of its own attempt; the driver's commit names the files of the attempts that Spark kept and deletes
    all others, so a retried or a speculative task leaves one copy. Overwriting deletes what was there only at that point. A null key is refused, null
    values are an empty array, a null number is a NaN. Reading gives (key, values) back, whole files a task.
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_arrays"

    def schema(self) -> str:
        return "key string, values array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        names = [f.name for f in schema.fields]
        if names != ["key", "values"]:
            raise ValueError(f"keyed_arrays takes the columns key and values, not {', '.join(names)}")
        return ArrayWriter(self.options["path"], overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = _at(self.path)
        return _dealt([f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".npz") and not f.base_name.startswith(".")])

    def read(self, partition: Files) -> Iterator[tuple]:
        import numpy as np

        system, _ = _at(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f, np.load(f) as arrays:
                for key in arrays.files:
                    yield key, arrays[key].astype(float).tolist()


class ArrayWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        import numpy as np
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        path, seen = f"{at}/.{self.id}-{context.partitionId()}-{context.taskAttemptId()}", set()
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, np.errstate(over="ignore"):
            for row in iterator:
                if row.key is None or row.key in seen:
                    raise ValueError(f"keyed_arrays: {'a key is null' if row.key is None else f'two arrays of key {row.key}'}")
                seen.add(row.key)
                with z.open(row.key + ".npy", "w", force_zip64=True) as f:
                    np.lib.format.write_array(f, np.array([np.nan if v is None else v for v in row["values"] or []], float).astype(np.float16), allow_pickle=False)
        if not seen:
            system.delete_file(path)
        return Written(path if seen else None, context.partitionId())

    def _hidden(self, system, at: str) -> list[str]:
        from pyarrow import fs

        return [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(f".{self.id}-")]

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".npz") and not f.base_name.startswith(".")] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{at}/part-{m.partition:05d}-{self.id}.npz")
        for path in [*old, *self._hidden(system, at)]:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, at = _at(self.path)
        for path in self._hidden(system, at):
            system.delete_file(path)


class PointClouds(DataSource):
    """(label, file, indices, values, shape) of the files <path>/<label>/*.npz: places in a grid of that shape and the values there.

    Folders whose name is no whole number are passed over, as are files of other endings. A file that is no archive or lacks one of the three arrays is left out; with
    the option corrupt=fail it fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "point_clouds"

    def schema(self) -> str:
        return "label int, file string, indices array<array<int>>, values array<double>, shape array<int>"

    def reader(self, schema) -> CloudReader:
        return CloudReader(self.options["path"], self.options.get("corrupt", "skip") == "skip")


class CloudReader(DataSourceReader):
    def __init__(self, path: str, skip: bool):
        self.path, self.skip = path, skip

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = _at(self.path)
        labels = [f.path for f in system.get_file_info(fs.FileSelector(at)) if not f.is_file and re.fullmatch(r"-?\d+", f.base_name)]
        return _dealt([f for d in labels for f in system.get_file_info(fs.FileSelector(d)) if f.is_file and f.base_name.endswith(".npz")])

    def read(self, partition: Files) -> Iterator[tuple]:
        import numpy as np

        system, _ = _at(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                data = f.read()
            try:
                with np.load(io.BytesIO(data)) as z:
                    indices, values, shape = z["indices"], z["values"], z["shape"]
                row = int(path.split("/")[-2]), path.rsplit("/", 1)[1], indices.astype(int).tolist(), values.astype(float).tolist(), shape.astype(int).tolist()
            except (zipfile.BadZipFile, zlib.error, KeyError, ValueError, EOFError, OSError):
                if not self.skip:
                    raise
                continue
            yield row
