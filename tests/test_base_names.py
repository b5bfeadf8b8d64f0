"""Stems that a text has by itself and that Windows reserves."""

from pyspark.sql import functions as F

from foliosmith.functions import text as X
from foliosmith.plans import queries


def test_reserved_stems_get_a_sign_wherever_they_come_from(spark, tmp_path):
    rows = [(12, "Aux."), (13, "con!"), (14, "Con man"), (20, "any")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["base"] for r in queries.QUERIES["base_names"](spark, str(tmp_path)).collect()}
    assert got == {12: "Aux_", 13: "con_", 14: "Con_man", 20: "CON_"}
    assert spark.range(1).select(X.base_name(F.lit("lpt1"))).first()[0] == "lpt1_"
