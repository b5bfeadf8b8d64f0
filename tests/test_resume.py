"""Answers that outlive a run that did not end, the bucketed memo, and requests in flight."""

import pathlib
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from foliosmith.operators import memo
from foliosmith.plans import config, inference, transcribe
from foliosmith.sources import files, memo_table
from foliosmith.sources.journal import Journal, Writer
from tests.test_runs import log_of, none, raw_pages


def counting(folder, stop_after=None, slow=0.0):
    """A backend that writes down what it is asked; after so many requests over all workers the whole worker fails, as one that is lost."""

    class Counting(inference.StubBackend):
        name = "counting"

        def answer(self, prompt, image):
            if stop_after is not None and len(list(folder.iterdir())) >= stop_after:
                raise SystemExit("the worker is gone")
            (folder / uuid.uuid4().hex).write_text(prompt)
            time.sleep(slow)
            return f"answer to {prompt}", "stop"

    return Counting


def requests(spark, n, parts):
    return spark.range(n).select(F.format_string("k%03d", "id").alias("key"), F.format_string("p%03d", "id").alias("prompt"), F.lit(None).cast("string").alias("image")).repartition(parts)


def ask(spark, items, backend, journal, **options):
    return memo.memoised(items, none(spark), lambda misses: inference.infer(misses, backend, journal=journal, **options), 2, logged=journal.answers(spark))


@pytest.mark.parametrize("in_flight", [1, 3])
def test_a_stopped_run_is_taken_up(spark, tmp_path, in_flight):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    journal, items = Journal(str(tmp_path / "journal"), every=4, fan=3), requests(spark, 200, 4).cache()
    with pytest.raises(Exception):
        ask(spark, items, counting(first, stop_after=90), journal, in_flight=in_flight)
    kept = {r["key"]: r["text"] for r in journal.answers(spark).collect()}
    told = log_of(first)
    assert 0 < len(kept) <= len(told) and len(told) - len(kept) <= 4 * (4 + in_flight)  # a batch and what was in flight for each of the tasks
    done, entries = ask(spark, items, counting(second), journal, in_flight=in_flight)
    assert {r["key"]: r["text"] for r in done.collect()} == {f"k{i:03d}": f"answer to p{i:03d}" for i in range(200)} == {r["key"]: r["text"] for r in entries.collect()}
    assert log_of(second) == sorted(f"p{i:03d}" for i in range(200) if f"k{i:03d}" not in kept)
    assert all(done.filter(F.col("key") == k).first()["text"] == v for k, v in list(kept.items())[:3])
    journal.clear()
    assert journal.answers(spark).count() == 0


def test_attempts_and_torn_files(spark, tmp_path, monkeypatch):
    """Of two attempts of a task the newest answer counts; a file that can't be read, or was not moved into place, has none."""
    root = tmp_path / "journal"
    assert Journal(str(root)).answers(spark).count() == 0
    old, new = Writer(str(root), "r", 1, 100), Writer(str(root), "r", 1, 100)
    new.attempt = 7
    for k in range(5):
        old.add(f"k{k}", "old", "stop")
    for k in range(3):
        new.add(f"k{k}", "new", "length")
    (root / ".passing.parquet.part").write_bytes(b"half")
    (root / "torn.parquet").write_bytes(b"PAR1 torn")
    got = {r["key"]: (r["text"], r["finish_reason"]) for r in Journal(str(root)).answers(spark).collect()}
    assert got == {f"k{k}": ("new", "length") if k < 3 else ("old", "stop") for k in range(5)}


def test_a_task_leaves_few_files(spark, tmp_path):
    log = Writer(str(tmp_path), "r", 2, 4)
    for k in range(1001):
        log.add(f"k{k}", f"t{k}", "stop")
    log.commit()
    assert len(list(tmp_path.glob("*.parquet"))) <= 4 * 5 and Journal(str(tmp_path)).answers(spark).count() == 1001


def test_refresh_asks_again(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    journal = Journal(str(tmp_path / "journal"))
    log = journal.writer("r")
    log.add("k000", "logged", "stop")
    log.commit()
    items = requests(spark, 3, 2)
    infer = lambda misses: inference.infer(misses, counting(asked))
    done, _ = memo.memoised(items, none(spark), infer, 2, logged=journal.answers(spark))
    assert {r["key"]: r["text"] for r in done.collect()}["k000"] == "logged" and len(log_of(asked)) == 2
    done, _ = memo.memoised(items, none(spark), infer, 2, refresh=True, logged=journal.answers(spark))
    assert {r["key"]: r["text"] for r in done.collect()}["k000"] == "answer to p000" and len(log_of(asked)) == 5


def test_a_pass_takes_up_its_answers(spark, tmp_path, monkeypatch):
    asked = tmp_path / "asked"
    asked.mkdir()
    monkeypatch.setitem(inference._BACKENDS, "told", counting(asked))
    own, journal = config.resolve({"vlm": {"backend": "told"}, "inference": {"in_flight": 2}}), Journal(str(tmp_path / "journal"))
    pages = transcribe.ocr_pass(raw_pages(spark))
    described, _ = transcribe.describe_figures(pages, none(spark), own, journal)
    first = sorted(r["description"] for r in described.collect())
    assert len(log_of(asked)) == 4  # and now the run ends before its entries are kept
    again, entries = transcribe.describe_figures(pages, none(spark), own, journal)
    assert sorted(r["description"] for r in again.collect()) == first and entries.count() == 4 and len(log_of(asked)) == 4


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_memo_table(spark, tmp_path):
    path, other = str(tmp_path / "it's a memo"), str(tmp_path / "compact")
    assert memo_table.read_memo(spark, path, 8).count() == 0
    entry = lambda lo, hi, text, day, schema=2: spark.range(lo, hi).select(F.format_string("k%03d", "id").alias("key"), F.lit(schema).alias("value_schema"), F.lit(text).cast("string").alias("text"), F.lit(day).cast("timestamp").alias("written_at"))
    memo_table.append_memo(entry(0, 50, "new", "2024-01-02").withColumn("truncated", F.col("key") == "k007"), path, 8)
    memo_table.append_memo(entry(0, 60, "old", "2024-01-01").unionByName(entry(60, 70, None, "2024-01-01")).unionByName(entry(60, 80, "x", "2024-01-01", 1)), path, 8)
    items = spark.range(100).select(F.format_string("k%03d", "id").alias("key"), "id")

    def check(table):
        hits, misses = memo.split_hits(items, table, 2)
        assert {r["id"]: (r["text"], r["truncated"]) for r in hits.collect()} == {k: ("new" if k < 50 else "old", k == 7) for k in range(60)}
        assert misses.columns == ["key", "id"] and sorted(r["id"] for r in misses.collect()) == list(range(60, 100))

    check(memo_table.read_memo(spark, path, 8))
    memo_table.compact(spark, path, other, 8)
    check(memo_table.read_memo(spark, other, 8))
    assert memo_table.read_memo(spark, other, 8).count() == 80 and len(list(pathlib.Path(other).glob("*.parquet"))) <= 8
    with pytest.raises(ValueError, match="8 buckets"):
        memo_table.read_memo(spark, path, 4)
    gone = sorted(pathlib.Path(path).glob("*.parquet"))[0]
    gone.write_bytes(b"no parquet")  # its entries are misses, the others stay
    hits, misses = memo.split_hits(items, memo_table.read_memo(spark, path, 8), 2)
    assert 0 < hits.count() <= 60 and hits.count() + misses.count() == 100


def test_the_memo_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo_table.append_memo(spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit(2).alias("value_schema"), F.lit("t").alias("text"), F.current_timestamp().alias("written_at")), path, 8)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between tables that are both large
    try:
        table = memo_table.read_memo(spark, path, 8)
        keys = spark.range(50).select(F.col("id").cast("string").alias("key"))
        found = memo.newest(table.join(keys, "key", "left_semi"), 2)
        plan = plan_of(keys.join(found, "key", "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    at, level = lines.index(scans[0]), depth(scans[0])
    for line in reversed(lines[:at]):  # from the scan up to the top
        if depth(line) < level:
            level = depth(line)
            assert "Exchange" not in line


def test_requests_in_flight():
    """At most so many at once, answers in the order of the requests, and not slower than that allows."""
    now, most, lock = [0], [0], threading.Lock()

    def slow(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if k % 3 else 0.05)
        with lock:
            now[0] -= 1
        return k

    began = time.time()
    assert list(inference._in_order(iter(range(40)), slow, 8)) == list(range(40))
    assert most[0] <= 8 and time.time() - began < 0.6 * sum(0.02 if k % 3 else 0.05 for k in range(40))
    assert list(inference._in_order(iter(range(5)), slow, 1)) == list(range(5)) and list(inference._in_order(iter([]), slow, 3)) == []


def test_passing_failures_are_tried_again():
    class Shaky(inference.StubBackend):
        def __init__(self, errors):
            super().__init__()
            self.errors = list(errors)

        def answer(self, prompt, image):
            if self.errors:
                raise self.errors.pop(0)
            return "x", "stop"

    ask = lambda *errors: inference._answered(Shaky(errors), "p", None, 3, 0.001)
    assert ask(ConnectionError("a"), TimeoutError("b")) == ("x", "stop", None)
    assert ask(ConnectionError("a"), ConnectionError("b"), ConnectionError("c")) == (None, None, "c")
    assert ask(ValueError("at once")) == (None, None, "at once")


def test_a_memo_that_can_not_be_read_is_no_empty_memo(spark, tmp_path):
    import foliosmith.__main__ as command

    assert command._memo(spark, str(tmp_path / "new")).count() == 0 and command._memo(spark, None).count() == 0
    spark.createDataFrame([], files.MEMO)
    path = str(tmp_path / "memo")
    memo_table.append_memo(none(spark).limit(0).unionByName(spark.createDataFrame([("k", 2, "t", None, False)], files.MEMO)), path, 4)
    with pytest.raises(ValueError, match="4 buckets"):
        command._memo(spark, path)
