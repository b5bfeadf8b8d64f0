"""Split documents put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

NOTICE = r"\n\s*---\s*\n\s*\*Transcribed with (OCR|OCR and VLMs);[^\n]*may contain mistakes\.\*\s*\z"
BIBTEX = r"\A```\n[\s\S]*?\n```\n\n---\n\n"


def read_part(content: Column) -> Column:
    """(body, noticed, vlm) of a part file: LF line ends, without its notice."""
    plain = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.struct(X.strip(F.regexp_replace(plain, NOTICE, "")).alias("body"), plain.rlike(NOTICE).alias("noticed"), (F.regexp_extract(plain, NOTICE, 1) == "OCR and VLMs").alias("vlm"))


def join_splits(parts: DataFrame, base: str = "base", part: str = "part", content: str = "content") -> DataFrame:
    """(base, full): main, appendix, back matter joined, the citation block in front and one notice at the end, if any part had one."""
    read = parts.select(base, part, read_part(F.col(content)).alias("p"))
    body = lambda name: F.max(F.when(F.col(part) == name, F.col("p.body")))
    made = read.groupBy(base).agg(body("main").alias("main"), body("appendix").alias("appendix"), body("backmatter").alias("backmatter"), F.max("p.noticed").alias("noticed"), F.max("p.vlm").alias("vlm")).filter("main is not null")
    cited = F.regexp_extract(F.col("main"), rf"({BIBTEX})", 1)
    own = X.strip(F.regexp_replace("main", BIBTEX, ""))
    joined = F.concat_ws("\n\n", X.present(own), X.present(F.col("appendix")), X.present(F.col("backmatter")))
    return made.select(base, F.concat(cited, F.when(F.col("noticed"), X.append_notice(joined, F.col("vlm"))).otherwise(F.concat(X.rstrip(joined), F.lit("\n")))).alias("full"))
