"""Output files in two phases: tasks stage them, the commit of the job publishes them together, or not at all.

A Python data source: each task writes its files into a hidden folder of its attempt below the output folder and hands their names to the
commit, so a failed or second attempt leaves nothing to be seen.  The commit moves them into place in the order of their names.  Without ``clobber`` each
name is claimed, and a name that is taken undoes what this commit has published; as all writers claim in the same order, of
several at once that share a name just one succeeds.  Only names go through the driver, never contents.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import stores

NAME = "foliosmith_files"
TAKEN = "is there already"


@dataclass
class Staged(WriterCommitMessage):
    """(name, staged path) of each file of one task."""

    files: list[tuple[str, str]]


def _checked(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"{name!r} names no file below the output folder")
    return name


class _Writer(DataSourceWriter):
    def __init__(self, root: str, clobber: bool):
        self.root, self.clobber = root, clobber
        self.stage = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        context, (store, folder) = TaskContext.get(), stores.opened(self.root)
        own, made = stores.joined(folder, f"{self.stage}/{context.partitionId()}-{context.taskAttemptId()}"), []
        for k, row in enumerate(iterator):
            if row["content"] is not None:
                data = row["content"].replace("\r\n", "\n").encode()
            else:
                origin, at = stores.opened(row["source"])
                with origin.open_input_stream(at) as file:
                    data = file.read()
            staged = stores.joined(own, str(k))
            stores.put(store, staged, data)
            made.append((_checked(row["file"]), staged))
        return Staged(made)

    def commit(self, messages: list) -> None:
        store, folder = stores.opened(self.root)
        try:
            files = sorted((stores.joined(folder, name), staged) for m in messages if m for name, staged in m.files)
            twice = next((a for (a, _), (b, _) in zip(files, files[1:]) if a == b), None)
            if twice:
                raise ValueError(f"{twice} would be written twice")
            self._publish(store, files)
        finally:
            self._clean(store, folder)

    def _publish(self, store: fs.FileSystem, files: list[tuple[str, str]]) -> None:
        if self.clobber:
            for parent in {final.rpartition("/")[0] for final, _ in files}:
                store.create_dir(parent, recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda f: store.move(f[1], f[0]), files))
            return
        done = []
        try:
            for final, staged in files:
                stores.claim(store, staged, final)
                done.append(final)
        except Exception as e:
            for own in done:
                store.delete_file(own)
            if isinstance(e, FileExistsError):
                raise FileExistsError(f"{final} {TAKEN}") from e
            raise

    def _clean(self, store: fs.FileSystem, folder: str) -> None:
        """Deletes what was staged; a task that is only just being ended may still write while that goes on."""
        at = stores.joined(folder, self.stage)
        for left in range(9, -1, -1):
            try:
                if store.get_file_info(at).type != fs.FileType.Directory:
                    return
                store.delete_dir(at)
            except OSError:
                if not left:
                    raise
            time.sleep(0.05)

    def abort(self, messages: list) -> None:
        self._clean(*stores.opened(self.root))


class StagedFiles(DataSource):
    """Writes rows (file, content, source): a text, or the bytes of the file at ``source``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, content string, source string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("clobber", "true") == "true")


def publish(files: DataFrame, root: str, clobber: bool = True) -> None:
    """Writes rows (file, content, source) below ``root``, all or none: a text in UTF-8 with LF line ends, or a copy of ``source`` where the content is null.

    A name that is taken is an error without ``clobber``, a name that several rows have always is one.
    """
    spark = files.sparkSession
    spark.dataSource.register(StagedFiles)
    try:
        files.select("file", F.col("content").cast("string"), F.col("source").cast("string")).write.format(NAME).option("clobber", str(clobber).lower()).mode("append").save(root)
    except PySparkException as e:
        told = next((line for line in str(e).splitlines() if TAKEN in line), None)
        if told:
            raise FileExistsError(told.partition("FileExistsError: ")[2] or told) from e
        raise
