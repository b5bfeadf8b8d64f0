"""Stems with number signs, joiners and letters in circles: the query against its SQL."""

import duckdb

from foliosmith.plans import queries


def test_number_signs_stay_and_other_signs_go_as_in_the_sql(spark, tmp_path):
    texts = ["H²O ½ Ⅳ", "a‿b", "a‌b‍b", "Ⓐ one", "ét", "x³", "٣ ४"]
    spark.createDataFrame([(10 * k + 2, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["base_names"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(queries.ORACLE_SQL["base_names"]).fetchall())
    assert (2, "H²O_½_Ⅳ") in got and (12, "a_b") in got
