"""A data source that writes files under their own paths, all of them or none.

Executors stage their files; nothing is seen below the root until the driver commits. A task attempt stages in a folder
of its own and reports no more than that folder's name and two counts, so what reaches the driver is a row a task. The
commit merges the folders of the attempts that succeeded, a whole folder in one rename wherever only one attempt has
it, and then renames the merged tree to the root. Folders of attempts that failed, or ran twice, go with the staging
folder, and an abort leaves nothing else.

Paths are those of a file system that pyarrow reaches from the driver and from every executor and that renames
folders: a shared folder, or hdfs://.
"""

from __future__ import annotations

import contextlib
import posixpath
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "place string, content binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


def allowed(place: str | None) -> bool:
    """Whether a place is a relative path that stays below its root."""
    return bool(place) and not place.startswith("/") and all(part not in ("", ".", "..") for part in place.split("/"))


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root.rstrip("/"), run

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, at = located(self.root)
        return system, at, f"{posixpath.dirname(at)}/.{posixpath.basename(at)}-{self.run}"

    def open(self) -> None:
        """Make the staging folder. Tasks make folders only within one that is there, so none comes back after an abort."""
        system, _, staging = self._staging()
        system.create_dir(staging, recursive=True)

    def write(self, iterator) -> Staged:
        system, _, staging = self._staging()
        folder, files, size, made = f"attempt-{TaskContext.get().taskAttemptId()}", 0, 0, {""}
        for row in iterator:
            place, content = row[0], row[1]
            if not allowed(place) or content is None:
                raise ValueError(f"no file can be written at {place!r}")
            parts = f"{folder}/{place}".split("/")
            for i in range(1, len(parts)):
                if (above := "/".join(parts[:i])) not in made:
                    if system.get_file_info(f"{staging}/{above}").type == fs.FileType.File:
                        raise FileExistsError(f"two files at {above}, or a file where a folder is")
                    system.create_dir(f"{staging}/{above}", recursive=False)
                    made.add(above)
            path = f"{staging}/{folder}/{place}"
            if system.get_file_info(path).type != fs.FileType.NotFound:
                raise FileExistsError(f"two files at {place}, or a file where a folder is")
            with system.open_output_stream(path) as out:
                out.write(bytes(content))
            files, size = files + 1, size + len(content)
        return Staged(folder, files, size)

    def _merge(self, system: fs.FileSystem, source: str, target: str) -> None:
        """Everything below source moved below target; a folder that target lacks in one rename."""
        for child in system.get_file_info(fs.FileSelector(source)):
            to = f"{target}/{child.base_name}"
            there = system.get_file_info(to)
            if there.type == fs.FileType.NotFound:
                system.move(child.path, to)
            elif there.type == child.type == fs.FileType.Directory:
                self._merge(system, child.path, to)
            else:
                raise FileExistsError(f"two files at {to.removeprefix(target)}, or a file where a folder is")

    def commit(self, messages: list) -> None:
        system, root, staging = self._staging()
        try:
            there = system.get_file_info(root)
            if there.type == fs.FileType.File or there.type == fs.FileType.Directory and system.get_file_info(fs.FileSelector(root)):
                raise FileExistsError(f"{self.root} exists and is not empty; name another run")
            tree = f"{staging}/tree"
            system.create_dir(tree, recursive=True)
            for message in messages:
                if message is not None and message.files:
                    self._merge(system, f"{staging}/{message.folder}", tree)
            if there.type == fs.FileType.Directory:
                system.delete_dir(root)
            system.move(tree, root)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        system, _, staging = self._staging()
        for _ in range(20):  # other tasks of the job may be writing still
            if system.get_file_info(staging).type == fs.FileType.NotFound:
                return
            with contextlib.suppress(OSError):
                system.delete_dir(staging)
            time.sleep(0.1)


class FileTree(DataSource):
    """df.write.format("filetree").mode("append").save(root), of rows (place, content)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is never written over another; name another run")
        if [f.name for f in schema.fields] != ["place", "content"]:
            raise ValueError(f"rows must be ({SCHEMA})")
        made = TreeWriter(self.options["path"], uuid.uuid4().hex)
        made.open()
        return made


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
