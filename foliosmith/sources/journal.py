"""A log of answers that outlives a run that did not end: each task commits small files of what it was told, and later runs ask only for the rest.

A file is written under a passing name and moved into place, so it is there whole or not at all; its name says which run, partition and
attempt of a task it is of.  A task that has committed ``fan`` files of a size puts them together into one, so a task leaves some ``fan`` files for each
power of ``fan``, however many answers it has.  Answers may be there several times (a retried or speculative attempt, a file that was put together while
its parts were still there); readers take the newest of each key.
"""

from __future__ import annotations

import datetime
import io
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import stores

ANSWERS = "key string, text string, finish_reason string, told_at timestamp, run string, part int, attempt int"
_SCHEMA = pa.schema([("key", pa.string()), ("text", pa.string()), ("finish_reason", pa.string()), ("told_at", pa.timestamp("us", "UTC")), ("run", pa.string()), ("part", pa.int32()), ("attempt", pa.int32())])


class Writer:
    """What one attempt of a task is told; made in the task."""

    def __init__(self, root: str, run: str, every: int, fan: int):
        context = TaskContext.get()
        self.store, self.folder = stores.opened(root)
        self.run, self.every, self.fan = run, every, fan
        self.part, self.attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        self.rows: list[tuple] = []
        self.levels: dict[int, list[str]] = {}
        self.count = 0

    def add(self, key: str, text: str, finish_reason: str) -> None:
        self.rows.append((key, text, finish_reason, datetime.datetime.now(datetime.UTC), self.run, self.part, self.attempt))
        if len(self.rows) >= self.every:
            self.commit()

    def commit(self) -> None:
        """What was told since the last commit becomes a file."""
        if self.rows:
            self._put(pa.Table.from_pylist([dict(zip(_SCHEMA.names, r)) for r in self.rows], _SCHEMA), 0)
            self.rows = []

    def _put(self, table: pa.Table, level: int) -> None:
        path = stores.joined(self.folder, f"{self.run}-{self.part}-{self.attempt}-{self.count}.parquet")
        self.count += 1
        data = io.BytesIO()
        pq.write_table(table, data)
        stores.put(self.store, path, data.getvalue())
        own = self.levels.setdefault(level, [])
        own.append(path)
        if len(own) >= self.fan:
            parts = []
            for p in own:
                with self.store.open_input_file(p) as file:
                    parts.append(pq.read_table(file, schema=_SCHEMA))
            gone, self.levels[level] = own, []
            self._put(pa.concat_tables(parts), level + 1)
            for p in gone:
                self.store.delete_file(p)


@dataclass(frozen=True)
class Journal:
    """The log in a folder that all executors see; ``every``: answers that a task holds before it commits them."""

    root: str
    every: int = 16
    fan: int = 16

    def writer(self, run: str) -> Writer:
        return Writer(self.root, run, self.every, self.fan)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(key, text, finish_reason): the newest of each key; none if there is no log yet, and a file that can't be read has none."""
        try:
            rows = spark.read.schema(ANSWERS).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(self.root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], ANSWERS)
        last = F.max_by(F.struct("text", "finish_reason"), F.struct("told_at", "attempt", "text")).alias("last")
        return rows.filter("key is not null and text is not null").groupBy("key").agg(last).select("key", "last.text", "last.finish_reason")

    def clear(self) -> None:
        """Forgets the answers, once a run has memoised them."""
        store, folder = stores.opened(self.root)
        if store.get_file_info(folder).is_file is False and store.get_file_info(folder).type.name == "Directory":
            store.delete_dir_contents(folder)
