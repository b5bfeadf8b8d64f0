"""Every label is learned, or training fails."""

import pytest
from pyspark.sql import functions as F

from foliosmith.llm import langid


def test_no_label_is_left_out(spark):
    docs = spark.range(520).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="512"):
        langid.training_windows(docs, F.lit(True), 1, 1, 16)
    few = docs.filter("doc_id < 5")
    with pytest.raises(ValueError):
        langid.fit(few, F.lit(True), most_langs=4)
    assert len(langid.fit(few, F.lit(True), per_lang=5, most_langs=5).langs) == 5
