"""One file per name: a data source that is written to, and the steps that list such folders and read their files in tasks.

Rows ``(name, value)`` that come sorted by name become files of lines in one folder, without a folder per name
as a partitioned write makes. A task holds one open file. It writes under a hidden name and moves the whole file to
its own, so that a task that is tried again, or twice at once, leaves the same files and readers never see half of one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_files"
# Columns of the steps that read, and the names, or bytes of text, that they hand on at a time.
FOLDERS, NAMES, TEXTS = "_split string, _folder string", "_split string, _folder string, _name string", "_split string, _text string"
LISTED, READ_BYTES = 10_000, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    files: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that ``path`` is in (mounted folders, and the stores that Arrow reaches by their URI)."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        # The folder is made by the driver, before any task.
        system, folder = _place(path)
        system.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.path)
        files, name, hidden, stream = 0, None, "", None

        def close() -> int:
            if stream is None:
                return 0
            stream.close()
            system.move(f"{folder}/{hidden}", f"{folder}/{name}")
            return 1

        for batch in iterator:
            for next_name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if next_name != name:
                    files += close()
                    name, hidden = next_name, f".{uuid.uuid4().hex}"
                    stream = system.open_output_stream(f"{folder}/{hidden}")
                stream.write(f"{value}\n".encode())
        return Written(files + close())

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        """Files that were moved are whole; hidden ones are read by nobody."""


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def is_folder(path: str) -> bool:
    """Whether Arrow reaches ``path`` and finds a folder there."""
    try:
        system, folder = _place(path)
        return system.get_file_info(folder).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        return False


def _names(path: str) -> Iterator[str]:
    """Names of the files that lie in a folder, without those that Spark takes as hidden. A mounted folder is gone through
    entry by entry; of other stores Arrow gives the listing whole."""
    system, folder = _place(path)
    if isinstance(system, fs.LocalFileSystem):
        found = ((e.name, e.is_dir()) for e in os.scandir(folder))
    else:
        found = ((i.base_name, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(folder)))
    for name, is_dir in found:
        if name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name:
            continue
        if not is_dir:
            yield name
        elif "=" in name:
            raise ValueError(f"{path} holds a folder of a partitioned table, {name}, and not documents alone")


def list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``FOLDERS`` to ``NAMES``, a row for each file that lies in a folder."""
    schema = pa.schema([(c, pa.string()) for c in ("_split", "_folder", "_name")])
    for batch in batches:
        for split, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for names in batched(_names(folder), LISTED):
                yield pa.RecordBatch.from_arrays([pa.repeat(split, len(names)), pa.repeat(folder, len(names)), pa.array(names)], schema=schema)


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``NAMES`` to ``TEXTS``: each file's whole text, unpacked as its name's end tells, in the encoding that its bytes tell.
    Bytes that are no text are an error."""
    schema = pa.schema([("_split", pa.string()), ("_text", pa.string())])
    splits, texts, held, places = [], [], 0, {}
    for batch in batches:
        for split, path, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path not in places:
                places[path] = _place(path)
            system, folder = places[path]
            with system.open_input_stream(f"{folder}/{name}") as stream:
                data = stream.read()
            splits.append(split)
            texts.append(data.decode(json.detect_encoding(data)))
            held += len(data)
            if held >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(splits, pa.string()), pa.array(texts, pa.string())], schema=schema)
                splits, texts, held = [], [], 0
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(splits, pa.string()), pa.array(texts, pa.string())], schema=schema)
