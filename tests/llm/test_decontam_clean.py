"""Rows with null and repeated ids in the removal of contaminated documents."""

import pytest

from foliosmith.llm import decontam


@pytest.mark.parametrize("block_chars", [10, 1000])
def test_clean_judges_each_row(spark, block_chars):
    items = spark.createDataFrame([(1, "a benchmark item of more than twenty-four characters"), (2, "another item that is long enough to be edited")], "item_id long, text string")
    rows = [(None, "x A benchmark item of more than twenty-four characters y"), (None, "clean"), (None, None), (3, "so another item that is long enough to be edited"), (3, "clean too"), (4, "fine")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string")
    got = [tuple(r) for r in decontam.clean(docs, items, block_chars=block_chars).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean", "z"), (None, None, "z"), (3, "clean too", "z"), (4, "fine", "z")], key=str)
    assert decontam.clean(docs, items.limit(0)).count() == len(rows)
