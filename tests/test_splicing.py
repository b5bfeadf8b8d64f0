"""Splicing as a list of segments against plain replacement from the last to the first, and its time on a page of very many tables."""

import random
import time

from pyspark.sql import functions as F

from foliosmith.functions import tables as T
from foliosmith.operators import tables as tables_op

ROW = "id int, t text, r array<struct<start:bigint,end:bigint,table:string>>".replace("text", "string")


def plain(text, replacements):
    for start, end, table in sorted(replacements, reverse=True):
        text = "\n\n".join(p for p in (text[:start].rstrip(), table.strip(), text[end:].lstrip()) if p)
    return text


def page(rng, n, every=False):
    """Text with n blobs, and replacements of some of them in any order."""
    text, found = rng.choice(["", "  ", " lead \n", "é"]), []
    for k in range(n):
        start = len(text)
        text += f"<table><td>{k}é</table>"
        if every or rng.random() < 0.6:
            found.append((start, len(text), rng.choice([f"|{k}|", f" |{k}|\n|-|\n", f"\n| é{k} |"])))
        text += rng.choice(["", " ", "\n\n", " mid é ", "  x\n y  ", "\n"])
    rng.shuffle(found)
    return text, found


def test_segments_are_plain_replacement(spark):
    rng = random.Random(3)
    pages = [page(rng, n) for n in [0, 1, 1, 2, 2, 3, 3, 5, 9, 63, 64, 65, 66, 128, 129, 200] * 3] + [("x", []), ("", []), ("<table></table>", [(0, 15, " ")]), (" a <table></table> b ", [(3, 18, "")])]
    rows = spark.createDataFrame([(k, t, r) for k, (t, r) in enumerate(pages)], ROW)
    got = {r["id"]: r["s"] for r in rows.select("id", T.splice(F.col("t"), F.col("r")).alias("s")).collect()}
    for k, (t, r) in enumerate(pages):
        assert got[k] == plain(t, r), (k, t[:80])


def test_very_many_tables_on_a_page(spark):
    def took(n):
        text, found = page(random.Random(n), n, every=True)
        text += " tail"
        rows = spark.createDataFrame([(0, text, found)], ROW).cache()
        rows.count()
        best = 1e9
        for _ in range(3):
            began = time.time()
            got = rows.select(T.splice(F.col("t"), F.col("r")).alias("s")).first()["s"]
            best = min(best, time.time() - began)
        assert got.count("|") >= 2 * n and got.endswith("tail")
        return best

    few, many = took(1000), took(5000)
    assert many < 5 * few + 2


def test_answers_of_a_page(spark):
    """Refused answers keep their blobs; a page without blobs, without answers, or of null text stays as it is."""
    blob = "<table><td>12</td></table>"
    pages = spark.createDataFrame([(1, f"a {blob} b {blob} c"), (2, "no table"), (3, None), (4, f"{blob}")], "p int, markdown string")
    found = tables_op.page_blobs(pages, "p", regions=None)
    assert sorted((r["p"], r["blob_idx"], r["blobs_on_page"], r["refinable"]) for r in found.collect()) == [(1, 1, 2, True), (1, 2, 2, True), (4, 1, 1, True)]
    answers = found.withColumn("answer", F.when((F.col("p") == 1) & (F.col("blob_idx") == 2), "| 12 |\n|-|").otherwise("no"))
    got = {r["p"]: (r["markdown"], r["tables_refined"]) for r in tables_op.splice_answers(pages, answers, "p").collect()}
    assert got == {1: (f"a {blob} b\n\n| 12 |\n|-|\n\nc", 1), 2: ("no table", 0), 3: (None, 0), 4: (blob, 0)}


def test_no_filter_finds_blobs_again(spark):
    pages = spark.createDataFrame([(1, "x")], "p int, markdown string")
    plan = tables_op.page_blobs(pages, "p", regions=None)._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().split("\n") if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("regexp" in line for line in filters)
