"""Files are read once; counts of a run come from its own jobs."""

import hashlib
import os

from pyspark.sql import functions as F

from foliosmith.plans import config, transcribe
from foliosmith.plans.metrics import Metrics
from foliosmith.sources import identity
from tests.test_runs import none, raw_pages


def rows(frame):
    return {r["path"].rpartition("/")[2]: r for r in frame.collect()}


def test_only_changed_files_are_read(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "digests")
    folder.mkdir()
    for name, data in (("a.pdf", b"%PDF-1 one"), ("b.pdf", b"no magic"), ("c.bin", b""), ("é d.pdf", b"%PDF" + bytes(3 << 20))):
        (folder / name).write_bytes(data)
    assert identity.read_digests(spark, table).count() == 0
    first = identity.identified(spark, str(folder), identity.read_digests(spark, table))
    identity.remember(first, table)
    got = rows(first)
    assert all(r["fresh"] for r in got.values()) and {n for n, r in got.items() if r["is_pdf"]} == {"a.pdf", "é d.pdf"}
    assert {n: r["sha256"] for n, r in got.items()} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir() if p.stat().st_size}

    (folder / "b.pdf").write_bytes(b"%PDF now")
    (folder / "new.pdf").write_bytes(b"%PDF new")
    at = os.stat(folder / "a.pdf")
    (folder / "a.pdf").write_bytes(b"%PDF-1 two")  # of the same length and time: who does not read it can't know
    os.utime(folder / "a.pdf", ns=(at.st_atime_ns, at.st_mtime_ns))
    second = identity.identified(spark, str(folder), identity.read_digests(spark, table))
    again = rows(second)
    assert {n for n, r in again.items() if r["fresh"]} == {"b.pdf", "new.pdf"} and again["b.pdf"]["is_pdf"]
    assert again["a.pdf"]["sha256"] == got["a.pdf"]["sha256"]
    identity.remember(second, table)
    identity.remember(second, table)  # known twice is known once
    third = identity.identified(spark, str(folder), identity.read_digests(spark, table))
    assert third.count() == 4 and third.filter("fresh").count() == 0
    plan = identity.listed(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_identity_is_of_the_content(spark, tmp_path):
    for sub in ("x", "y"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "m.gguf").write_bytes(b"weights")
    named = identity.identified(spark, str(tmp_path / "*")).select(identity.identity(F.col("path"), F.col("length"), F.col("sha256")).alias("i")).distinct().collect()
    assert [r["i"] for r in named] == [f"m.gguf:7:{hashlib.sha256(b'weights').hexdigest()}"]


def test_counts_of_a_run(spark):
    counts, sources = Metrics(), spark.createDataFrame([("a", None, "a"), ("b", None, "b")], "doc_id string, url string, name string")
    own = config.resolve({"bibtex": {"mode": "off"}})
    files, _, entries = transcribe.run_whole(raw_pages(spark), sources, none(spark), None, own, metrics=counts)
    told = counts.told()
    assert told == {"hits": 0, "misses": 8, "pages": 4, "figures": 4, "tables_refined": 0, "files": files.count()}  # a table and a figure a page; the stub's tables are refused
    kept = Metrics()
    transcribe.run_whole(raw_pages(spark), sources, entries, None, own, metrics=kept)
    assert kept.told() == {**told, "hits": entries.count(), "misses": 8 - entries.count()} and entries.count() == 4
