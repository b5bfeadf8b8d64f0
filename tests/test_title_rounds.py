"""Title links dealt out in rounds: every pair of blocks meets once, and no list is on disk often."""

import glob
import os
import random
import threading
import time

from pyspark.sql import functions as F, types as T

from foliosmith.operators import titles


def test_every_pair_of_blocks_meets_once(spark):
    for n in (1, 2, 3, 6, 7):
        rows = [(k, k % n, [1, 2, 3, 4], [1, 1, 1, 1]) for k in range(3 * n)]
        lists = spark.createDataFrame(rows, "id long, block int, words array<long>, counts array<int>")
        met = [tuple(r) for k in range(n // 2 + 1) for r in titles._round(lists, n, k, T.LongType()).collect()]
        assert len(met) == len(set(met)) and set(met) == {(a, b) for a in range(3 * n) for b in range(3 * n) if a != b}


def test_lists_are_not_on_disk_once_a_block(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(500))) for k in range(300)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    tops = glob.glob("/tmp/blockmgr-*")
    size = lambda: sum(os.path.getsize(f) for top in tops for f in glob.glob(f"{top}/*/shuffle_*.data") if os.path.exists(f))
    start, most, end = size(), [0], threading.Event()

    def watch():
        while not end.is_set():
            most[0] = max(most[0], size())
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert titles.title_links(docs, least_blocks=16).filter(F.col("link") == "match").count() == 0
    finally:
        end.set()
        watcher.join()
    assert most[0] - start < 5 * 300 * 500 * 8
