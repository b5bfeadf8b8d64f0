"""Edges of short items."""

import pytest

from foliosmith.llm import decontam


@pytest.mark.parametrize("text, found", [
    ("A short item.", True), ("(short item), he said", True), ("\u201cShort  item\u201d", True), ("short item", True), ("x short item!", True),
    ("short items", False), ("ashort item", False), ("short item_2", False), ("short item9", False), ("short item\u0301 x", False), ("short items, a short item; end", True),
])
def test_short_items_end_at_word_ends(text, found):
    assert bool(decontam.Matcher([(1, "short item")]).search(text)) is found


def test_short_item_at_the_start():
    assert decontam.Matcher([(1, "short item")]).search("Short item, then") == [(1, 0, 0, 10)]
