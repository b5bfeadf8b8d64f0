"""Documents from a stream of pages: state by document, event-time timers.

A page arrives with the number of pages of its document.  A document is given out once, when its last page is there, or, marked as incomplete with the
pages that lack, when none of its pages arrived for ``wait`` of event time.  Its state goes then; a mark of its end stays for another ``wait``, so that
a page that comes again does not start it anew.  Pages are held one entry each, so an arrival never rewrites those before it.

Needs the session's state store to be RocksDB (``spark.sql.streaming.stateStore.providerClass``).

Defined results: of several texts of one page the first by arrival counts, of equal arrival the least; of several page totals the largest so far; a
null text adds nothing, as in a batch; rows without a document, page number or arrival are left out; pages older than the watermark are dropped by
Spark, so a document that only waits for them ends by its timer; page numbers above the total count as pages, those that lack are of 1 to the total.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import pages as pages_op

ENDED = "doc_id string, pages array<struct<page_number:int,body:string>>, complete boolean, missing array<int>"


class Collector(StatefulProcessor):
    """Pages of one document at a time, until it is complete or its timer ends."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_number int", "arrived long, body string")
        self.about = handle.getValueState("about", "total int, held int, last long, ended boolean")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _document(self, key: tuple, total: int) -> Row:
        held = sorted((number[0], page[1]) for number, page in self.pages.iterator())
        numbers = {number for number, _ in held}
        missing = [n for n in range(1, total + 1) if n not in numbers]
        return Row(doc_id=key[0], pages=[Row(page_number=n, body=b) for n, b in held], complete=not missing, missing=missing)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, held, last, ended = self.about.get() if self.about.exists() else (0, 0, 0, False)
        if ended:
            return
        for row in rows:
            number = (row["page_number"],)
            new = (row["at"], row["body"])
            if not self.pages.containsKey(number):
                held += 1
                self.pages.updateValue(number, new)
            elif (new[0], new[1] or "") < (lambda old: (old[0], old[1] or ""))(self.pages.getValue(number)):
                self.pages.updateValue(number, new)
            total, last = max(total, row["total"] or 0), max(last, row["at"])
        # Counting comes first, as looking for what lacks reads the whole document.
        done = self._document(key, total) if total and held >= total else None
        ended = done is not None and done["complete"]
        if ended:
            self.pages.clear()
        self.about.update((total, 0 if ended else held, last, ended))
        self._timer(last + self.wait_ms)
        if ended:
            yield done

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total, _, last, ended = self.about.get()
        if ended:
            self.about.clear()
            return
        document = self._document(key, total)
        self.pages.clear()
        self.about.update((total, 0, last, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.wait_ms)
        # Without a total nobody knows whether pages lack.
        yield Row(doc_id=document["doc_id"], pages=document["pages"], complete=bool(total) and document["complete"], missing=document["missing"])

    def close(self) -> None:
        pass


def documents(pages: DataFrame, wait_seconds: int = 600, text: str = "markdown", total: str = "total_pages", page_numbers: bool = False, page_separators: bool = False, normalize: bool = True) -> DataFrame:
    """(doc_id, markdown, n_pages, complete, missing) of a stream of pages (doc_id, page_number, total_pages, arrived, text)."""
    body = pages_op.page_body(F.col(text), F.col("page_number"), page_numbers, normalize)
    rows = pages.filter("doc_id is not null and page_number is not null and arrived is not null").withWatermark("arrived", f"{wait_seconds} seconds")
    made = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.col(total).cast("int").alias("total"), "arrived", F.unix_millis("arrived").alias("at"), body.alias("body"))
    ended = made.groupBy("doc_id").transformWithState(statefulProcessor=Collector(1000 * wait_seconds), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")
    return ended.select("doc_id", pages_op.joined_bodies(F.transform("pages", lambda p: p["body"]), page_separators).alias("markdown"), F.size("pages").alias("n_pages"), "complete", "missing")
