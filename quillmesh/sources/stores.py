"""Data sources for Spark: a session store read by its index, and notes written as one named file each.

    register(spark)
    spark.read.format("session_store").load(root)
    notes.write.format("note_files").mode("append").save(root)

Files are opened by pyarrow's file systems, so a root is a local path or a URI that those know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Session files that one task reads, unless the option files_a_task says otherwise.
FILES_A_TASK = 200
SESSIONS = "id string, created_at string, updated_at string, tags array<string>, messages array<struct<role:string,content:string>>, timezone string, timezone_offset string, month string, path string, planned string"
INDEX_VERSION = 1
#: A month's folder, a session's file in it, and the older layout's file beside the folders.
MONTH, IN_MONTH, FLAT = r"\d{4}-\d{2}", r".+\.json", r"\d{8}_\d{6}\.json"


def opened(root: str):
    """pyarrow's file system of a root, and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(root))


def read_bytes(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def month_of(relative: str) -> str:
    """YYYY-MM of a session's path: its folder's, or of the older layout's file name."""
    first = relative.split("/")[0]
    return first if re.fullmatch(MONTH, first) else f"{first[:4]}-{first[4:6]}"


def planned_paths(root: str) -> tuple[str, list[str]]:
    """("index", the paths that the store's index names), or without a sound index that names any ("scan", those of the
    months' folders and of the older flat layout)."""
    from pyarrow import fs

    store, base = opened(root)
    try:
        index = json.loads(read_bytes(store, f"{base}/index.json"))
        if index["version"] == INDEX_VERSION and index["sessions"]:
            return "index", sorted(e["path"] for e in index["sessions"].values())
    except (FileNotFoundError, ValueError, KeyError, TypeError, AttributeError):
        pass  # no index, or none that can be used: the folders tell
    found = []
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.type == fs.FileType.Directory and re.fullmatch(MONTH, f.base_name):
            found += [f"{f.base_name}/{g.base_name}" for g in store.get_file_info(fs.FileSelector(f.path)) if g.type == fs.FileType.File and re.fullmatch(IN_MONTH, g.base_name)]
        elif f.type == fs.FileType.File and re.fullmatch(FLAT, f.base_name):
            found.append(f.base_name)
    return "scan", sorted(found)


def session_row(relative: str, raw: bytes, planned: str) -> tuple | None:
    """A session file's row (see SESSIONS); None if it is no session."""
    try:
        s = json.loads(raw)
        messages = [(m.get("role"), m.get("content")) for m in s.get("messages") or []]
        return (s["id"], s.get("createdAt"), s.get("updatedAt"), s.get("tags") or [], messages, s.get("timezone"), None if (o := s.get("timezoneOffset")) is None else str(o), month_of(relative), relative, planned)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@dataclass
class Files(InputPartition):
    paths: list[str]


class SessionReader(DataSourceReader):
    def __init__(self, root: str, size: int = FILES_A_TASK):
        self.root, self.size = root, size
        self.planned, self.paths = planned_paths(root)

    def partitions(self) -> list[Files]:
        return [Files(self.paths[k : k + self.size]) for k in range(0, len(self.paths), self.size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, base = opened(self.root)
        for p in partition.paths:
            try:
                raw = read_bytes(store, f"{base}/{p}")
            except FileNotFoundError:  # gone since it was named
                continue
            row = session_row(p, raw, self.planned)
            if row is not None:
                yield row


class SessionStore(DataSource):
    """Sessions under a root, planned from its index.json; where that is missing, unreadable, empty or of another version, from
    its folders YYYY-MM and the older flat layout YYYYMMDD_HHMMSS.json. `planned` says which. Files that are gone or are no
    sessions give no row; a root that does not exist gives none."""

    @classmethod
    def name(cls) -> str:
        return "session_store"

    def schema(self) -> str:
        return SESSIONS

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"], int(self.options.get("files_a_task", FILES_A_TASK)))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


def safe_path(path: str | None) -> str:
    """A path below the root, in normal form; one that leaves the root, or names nothing, is an error."""
    normal = posixpath.normpath(path or "")
    if normal in (".", "") or normal.startswith(("/", "../")) or normal == "..":
        raise ValueError(f"not a path below the root: {path!r}")
    return normal


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.at = root, f".staged-{uuid.uuid4().hex}"
        self.path, self.content = columns.index("path"), columns.index("content")

    def write(self, rows: Iterator) -> Staged:
        store, base = opened(self.root)
        folder, n = f"{self.at}/{uuid.uuid4().hex}", 0  # each try of a task has its own
        for row in rows:
            to = f"{base}/{folder}/{safe_path(row[self.path])}"
            store.create_dir(posixpath.dirname(to), recursive=True)
            with store.open_output_stream(to) as f:
                f.write((row[self.content] or "").encode())
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves each task's files to their names, a folder at a time."""
        from pyarrow import fs

        store, base = opened(self.root)
        for m in messages:
            if m is None or not m.files:
                continue
            folder = f"{base}/{m.folder}"
            for f in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                if f.type == fs.FileType.File:
                    to = f"{base}/{f.path[len(folder) + 1 :]}"
                    store.create_dir(posixpath.dirname(to), recursive=True)
                    store.move(f.path, to)
        self._clear(store, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.at}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.at}")


class NoteFiles(DataSource):
    """Rows of path (below the root) and content, written as one UTF-8 file each; other columns are not written, a null content
    is an empty file. Files come to their names when all tasks have ended well, and a failed job leaves none; one that is
    there already is replaced, so writing again leaves the same files. A path that leaves the root fails the job."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(SessionStore)
    spark.dataSource.register(NoteFiles)
