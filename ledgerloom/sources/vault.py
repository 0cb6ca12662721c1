"""Notes as files: a data source that writes a file a note, all of them or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

CURRENT = "CURRENT"


@dataclass
class Written(WriterCommitMessage):
    notes: int


class NoteWriter(DataSourceWriter):
    """Tasks write into the folder of a new version, the commit points CURRENT to it, and an abort removes it.

    A file gets its name when it is whole, and tasks that run twice write the same files, so lost executors and
    speculation do no harm. The driver holds a number a task. Former versions stay.
    """

    def __init__(self, path: str):
        self.path, self.version = path, f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = fs.FileSystem.from_uri(self.path)
        made, n = set(), 0
        for row in iterator:
            if any(not x or "/" in x or "\\" in x or x.strip(".") == "" for x in (row.folder, row.name)) or row.note is None:
                raise ValueError(f"no file can be made of {row.folder!r}/{row.name!r}")
            folder = f"{base}/{self.version}/{row.folder}"
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            part = f"{base}/{self.version}/.part-{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(row.note.encode())
            files.move(part, f"{folder}/{row.name}.md")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{base}/{self.version}")
        part = f"{base}/.{CURRENT}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(f"{self.version}\n{sum(m.notes for m in messages if m)}\n".encode())
        files.move(part, f"{base}/{CURRENT}")

    def abort(self, messages: list[Written | None]) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{base}/{self.version}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.version}")


class NoteFiles(DataSource):
    """Format `note_files`: rows (folder, name, note) become <path>/<version>/<folder>/<name>.md; path is a URI or an absolute path."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        missing = {"folder", "name", "note"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"notes lack {sorted(missing)}")
        return NoteWriter(self.options["path"].rstrip("/"))


def write_notes(notes: DataFrame, path: str) -> None:
    """Replaces the notes under a path by these (folder, name, note; see `projection.note_files`)."""
    notes.sparkSession.dataSource.register(NoteFiles)
    notes.select("folder", "name", "note").write.format("note_files").option("path", path).mode("append").save()


def current_notes(path: str) -> tuple[str, int]:
    """The folder of the notes last written, and their number."""
    files, base = fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{base}/{CURRENT}") as held:
        version, n = held.read().decode().split()
    return f"{base}/{version}", int(n)
