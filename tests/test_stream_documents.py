"""Documents of a stream of pages against the batch result: shuffled arrivals, repeats, restarts, documents that never end."""

import random

import pytest
from pyspark.sql import functions as F

from foliosmith.operators import pages as pages_op
from foliosmith.streaming import documents as streaming

PAGE = "doc_id string, page_number int, total_pages int, arrived timestamp, markdown string"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, old)


def run(spark, tmp_path):
    """One run of the stream over what has arrived since the last one; the checkpoint is kept."""
    arrived = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming.documents(arrived, wait_seconds=600)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    return {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}, spark.read.parquet(str(tmp_path / "out")).count()


def test_stream_of_pages_equals_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(8)
    rows = [(f"d{d}", p, n, f"2024-01-01 00:0{rng.randrange(5)}:00", f"\nPage {p} of d{d} hyph-\n  ens\n\n\n\nend") for d, n in enumerate((1, 2, 5, 9)) for p in range(1, n + 1)]
    rows += [("lost", p, 4, "2024-01-01 00:01:00", f"kept {p}") for p in (4, 2)] + [("null", 1, 2, "2024-01-01 00:01:00", None), ("null", 2, 2, "2024-01-01 00:01:00", "x")]
    frame = lambda part: spark.createDataFrame(part, PAGE.replace("timestamp", "string")).withColumn("arrived", F.col("arrived").cast("timestamp")).coalesce(1)
    batch = {r["doc_id"]: r["markdown"] for r in pages_op.stitch_pages(frame(rows), "doc_id", "page_number", "markdown").collect()}
    shuffled = rows + rng.sample(rows, 6)
    rng.shuffle(shuffled)
    frame(shuffled[: len(shuffled) // 2]).write.mode("append").parquet(str(tmp_path / "in"))
    first, _ = run(spark, tmp_path)
    frame(shuffled[len(shuffled) // 2 :] + [(None, 1, 1, "2024-01-01 00:01:00", "x"), ("none", None, 1, "2024-01-01 00:01:00", "x")]).write.mode("append").parquet(str(tmp_path / "in"))
    second, n = run(spark, tmp_path)
    assert n == len(second) and set(first) <= set(second) and "lost" not in second
    whole = {k for k in batch if k != "lost"}
    assert set(second) == whole and all(second[k]["markdown"] == batch[k] and second[k]["complete"] and not second[k]["missing"] for k in whole)
    # Much later pages move the watermark past the timers.
    for day, minute in ((1, 20), (1, 50), (2, 30)):
        frame([(f"later{minute}", 1, 2, f"2024-01-0{day} 00:{minute}:00", "x")]).write.mode("append").parquet(str(tmp_path / "in"))
        third, n = run(spark, tmp_path)
    assert n == len(third) and (third["lost"]["complete"], third["lost"]["missing"], third["lost"]["markdown"]) == (False, [1, 3], batch["lost"])
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "about").load()
    assert {r["key"]["doc_id"] for r in held.select("key").collect()} <= {"later50", "later30"}
    pages = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "pages").load()
    assert pages.count() == 1
