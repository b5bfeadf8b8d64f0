"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. language_id: trains on the labelled rows of its input, rejects documents without a letter or whose language is hardly likelier than chance.
2. ngram_join: near duplicates on five-word shingles with a Jaccard similarity of 0.8 or more; the smallest id of each group stays.
3. decontamination: removes documents that hold a benchmark item, whatever their id.
4. pii: replaces personal data by the name of its kind.
5. packing: packs token ids into sequences.

Stages that send whole texts to Python take small Arrow batches, so that executors' memory is bounded by their heap and little more.
All stages but the last return the columns they are given.  Null texts go at the first stage (they have no language); empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliosmith.llm import decontam, langid, ngramjoin, packing, pii
from foliosmith.llm.queries import public_vocabulary, table
from foliosmith.llm.storage import rows_a_batch, written

#: A language is rejected below this part of the way from chance to certainty: 0.3 with four languages, 0.53 with two.
LEAST_GAIN = 1 / 15


def least_score(n_langs: int) -> float:
    """The probability that a language must have; with one language or none it tells nothing, and nothing is rejected by it."""
    return 1 / n_langs + (1 - 1 / n_langs) * LEAST_GAIN if n_langs > 1 else 0.0


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows_a_batch(spark, whole_texts=True)
    model = langid.fit(docs, F.lit(True))
    lang, sure = unused(docs, "__lang"), unused(docs, "__sure")
    seen = langid.predict(docs, model, keep=docs.columns, names=(lang, sure))
    return seen.filter((F.col(lang) != langid.UND) & (F.col(sure) >= least_score(len(model.langs)))).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows_a_batch(spark, whole_texts=False)
    return ngramjoin.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows_a_batch(spark, whole_texts=True)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = unused(docs, "__pii")
    clean = pii.redact(pii.find_pii(docs, out_col=found), pii_col=found)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows_a_batch(spark, whole_texts=True)
    return packing.pack(docs, public_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("pii", remove_pii),
    ("packing", pack_sequences),
]

#: Training and tokenization have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
